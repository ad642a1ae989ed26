"""Ordered rules over columns: the engine for classification, scoring and section assignment.

Which rules apply is a matter of the user; the engine evaluates any list of them in one projection, first match first, so that the optimizer sees one
``CASE`` and short-circuits it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``value`` where ``pattern`` is found in ``field`` and ``unless`` is not."""

    value: str
    pattern: str
    field: str = "title"
    unless: str | None = None

    def holds(self) -> Column:
        found = F.coalesce(F.col(self.field).rlike(self.pattern), F.lit(False))
        return found if self.unless is None else found & ~F.coalesce(F.col(self.field).rlike(self.unless), F.lit(False))


def first_match(rules: list[Rule], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise).cast("string")
    for r in reversed(rules):
        out = F.when(r.holds(), F.lit(r.value)).otherwise(out)
    return out


def evidence(rules: list[Rule]) -> Column:
    """What the first rule that holds has found, or null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.holds(), F.regexp_extract(F.col(r.field), r.pattern, 0)).otherwise(out)
    return out


def all_matches(rules: list[Rule]) -> Column:
    """The values of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(r.holds(), F.lit(r.value)) for r in rules]))


def score(points: list[tuple[Column, int]], base: Column | None = None) -> Column:
    """The sum of the points whose condition holds."""
    total = base if base is not None else F.lit(0)
    for condition, n in points:
        total = total + F.when(condition, n).otherwise(0)
    return total.cast("int")


#: Seasons of recruiting cycles, tested in this order, with the years they are read with.
SEASONS = ["fall", "winter", "spring", "summer"]


def season_cycle(text: Column) -> Column:
    """``Summer 2027`` from a season and a year next to each other, in either order; null without one."""
    out = F.lit(None).cast("string")
    for s in reversed(SEASONS):
        after, before = rf"(?i)(?<![a-z]){s}(?: quarter| term| semester)?[\s,]+'?(?:20)?(\d\d)(?!\d)", rf"(?i)(?<!\d)(?:20)?(\d\d)\s+{s}(?![a-z])"
        year = F.coalesce(F.nullif(F.regexp_extract(text, after, 1), F.lit("")), F.nullif(F.regexp_extract(text, before, 1), F.lit("")))
        out = F.when(year.isNotNull(), F.concat(F.lit(f"{s.capitalize()} 20"), year)).otherwise(out)
    return out


#: Tools named in postings.
SKILLS = [
    Rule("Python", r"(?i)(?<![a-z0-9])python(?![a-z0-9])", "text"), Rule("SQL", r"(?i)(?<![a-z0-9])sql(?![a-z0-9])", "text"), Rule("Java", r"(?i)(?<![a-z0-9])java(?![a-z0-9])", "text"),
    Rule("Spark", r"(?i)(?<![a-z0-9])spark(?![a-z0-9])", "text"), Rule("Kafka", r"(?i)(?<![a-z0-9])kafka(?![a-z0-9])", "text"), Rule("Docker", r"(?i)(?<![a-z0-9])docker(?![a-z0-9])", "text"),
]
