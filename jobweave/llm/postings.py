"""Reading rows about postings into comparable descriptors: who, what, when, where, and the link."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import bounded
from jobweave.llm.consensus import usable_url
from jobweave.llm.location_mapping import COLUMNS, SHARD_ROWS
from jobweave.llm.name_variants import link_names
from jobweave.llm.places import Places
from jobweave.llm.titles import STANDARD_SHARE, Titles, standard_tokens
from jobweave.session import write_shared

#: Of the standard spellings there are at most 1/STANDARD_SHARE times the words of a title; more than this is an error.
MAX_STANDARD = 50_000


def link_key(url: Column) -> Column:
    """A posting's address without scheme, ``www.``, query, fragment and final slash, in lower case; null if it is no address of a posting."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", ""))
    return F.when(usable_url(F.trim(url)), F.regexp_replace(F.regexp_replace(bare, r"^https?://(?:www\.)?", ""), r"/apply$", ""))


def count_tokens(titles: DataFrame, before: DataFrame | None = None, n: int = 0) -> tuple[DataFrame, int]:
    """(t, count of the tokens of all titles, in the column ``title``; number of titles), with the counts of earlier calls added."""
    tokens = titles.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{3,})")))).alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("count"))
    if before is not None:
        counts = counts.unionByName(before).groupBy("t").agg(F.sum("count").alias("count"))
    return counts, n + titles.where("title is not null").count()


def standard_list(counts: DataFrame, n: int) -> dict[str, int]:
    """Tokens that count as correctly spelt, from the counts over all titles."""
    often = counts.where(F.col("count") >= max(3.0, STANDARD_SHARE * n))
    return standard_tokens({r[0]: r[1] for r in bounded(often.select("t", "count"), MAX_STANDARD, "the list of standard spellings")}, n)


def read_standard(titles: DataFrame) -> dict[str, int]:
    """Tokens that count as correctly spelt of one set of titles."""
    return standard_list(*count_tokens(titles))


_READERS: dict[tuple, tuple[Titles, Places, dict]] = {}


def _reader(standard: dict[str, int], places_rows: list[tuple]) -> tuple[Titles, Places, dict]:
    """The readers for these lists and what they have read, kept by the worker from task to task; only the last ones are."""
    key = (hash(frozenset(standard.items())), hash(tuple(places_rows)))
    if key not in _READERS:
        _READERS.clear()
        places = Places(sorted(places_rows))
        _READERS[key] = (Titles(standard, places), places, {})
    return _READERS[key]


def read_postings(rows: DataFrame, standard: dict[str, int], reference: DataFrame) -> DataFrame:
    """``rows`` (key, title, team, place, hint) with signature, cycle, places: one pass without any shuffle.

    Each task keeps what it has read, so a text that repeats costs one reading; only the four columns cross to Python. The cycle is that of the title, else of ``hint``; places are those
    of ``place``, else of the title. What is missing or says nothing is '' or an empty array.
    """
    places_rows = [tuple(r) for r in bounded(reference.select(*COLUMNS).where("location_id is not null").distinct(), SHARD_ROWS, "the list of places for reading titles")]

    @F.pandas_udf("signature string, cycle string, places array<int>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        titles, places, cache = _reader(standard, places_rows)
        for batch in batches:
            sig, cyc, loc = [], [], []
            for title, team, place, hint in zip(*(b.tolist() for b in batch)):
                title = title or ""
                got = cache.get(title)
                if got is None:
                    if len(cache) > 100_000:
                        cache.clear()
                    got = cache[title] = titles.read(title)
                s, c, p = got
                if team:
                    more = titles.read(team)[0]
                    if more:
                        s = " ".join(sorted(set(s.split()) | set(more.split())))
                if not c and hint:
                    c = titles.read(hint)[1]
                q = places.read(place)[1]
                sig.append(s)
                cyc.append(c)
                loc.append(q or p)
            yield pd.DataFrame({"signature": sig, "cycle": cyc, "places": loc})

    keep = [c for c in rows.columns if c not in ("title", "team", "place", "hint")]
    return rows.select(*keep, read("title", "team", "place", "hint").alias("_r")).select(*keep, "_r.signature", "_r.cycle", "_r.places")


def entities(names: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """name, entity of all names of the column ``name``."""
    return link_names(names, aliases)


def add_entities(names: DataFrame, aliases: DataFrame | None, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(name, entity of ``names``; those not in ``known``, the dictionary so far). A new name that links to known ones gets their entity; what is known never changes.

    The dictionary holds distinct names, not rows; the names are linked anew with it only when there are new ones.
    """
    distinct = names.select("name").where(F.trim("name") != "").distinct()
    if known is None:
        linked = write_shared(link_names(distinct, aliases), "entities")
        return linked, linked
    fresh = write_shared(distinct.join(known, "name", "left_anti"), "new-names")
    if fresh.isEmpty():
        return distinct.join(known, "name"), known.limit(0)
    linked = write_shared(link_names(known.select("name").unionByName(fresh), aliases).withColumnRenamed("entity", "cluster"), "entities")
    held = linked.join(known, "name").groupBy("cluster").agg(F.min("entity").alias("entity"))
    added = write_shared(linked.join(fresh, "name", "left_semi").join(held, "cluster", "left").select("name", F.coalesce("entity", "cluster").alias("entity")), "new-entities")
    return distinct.join(known.unionByName(added), "name"), added
