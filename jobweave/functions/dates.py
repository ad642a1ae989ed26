"""Dates as lists and boards print them, against a clock that is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "America/Los_Angeles"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: A written moment at midnight UTC means the day and no hour.
_DAY_ONLY = r"T00:00:00(?:\.000)?Z$"


def parse_posted_at(cell: Column, now: Column) -> Column:
    """``9d``, ``1mo``, ``2y`` before ``now`` (30 and 365 days), or ``Jul 31`` as the latest such day not after it; null for anything else."""
    text = F.lower(F.trim(cell))
    p = r"^(\d+)\s*(d|mo|y)$"
    days = F.regexp_extract(text, p, 1).try_cast("int") * F.when(F.regexp_extract(text, p, 2) == "d", 1).when(F.regexp_extract(text, p, 2) == "mo", 30).otherwise(365)
    q = r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2})$"
    at = F.instr(F.lit(_MONTHS), F.nullif(F.regexp_extract(text, q, 1), F.lit("")))
    month = F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))
    made = lambda year: F.try_make_timestamp(year, month, F.regexp_extract(text, q, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    this = made(F.year(now))
    return F.when(text.rlike(p), F.timestamp_micros(F.unix_micros(now) - days.cast("long") * 86_400_000_000)).otherwise(F.when(this > now, made(F.year(now) - 1)).otherwise(this))


def parse_listed_date(text: Column) -> Column:
    """``August 18, 2026`` as its start in UTC, or null."""
    p = r"(?i)^([a-z]+)\s+(\d{1,2}),\s*(\d{4})$"
    bare = F.trim(text)
    normal = F.concat_ws(" ", F.initcap(F.regexp_extract(bare, p, 1)), F.concat(F.regexp_extract(bare, p, 2), F.lit(",")), F.regexp_extract(bare, p, 3))
    return F.when(bare.rlike(p), F.try_to_timestamp(normal, F.lit("MMMM d, yyyy")))


def parse_prose_day(text: Column, now: Column) -> Column:
    """``Posted Today``, ``Yesterday``, ``5 Days Ago`` or ``30+ Days Ago`` as a Pacific calendar day at midnight UTC, or null."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^posted\s+", "")
    p = r"^(\d+)\+?\s+days?\s+ago$"
    days = F.when(bare == "today", 0).when(bare == "yesterday", 1).when(bare.rlike(p), F.regexp_extract(bare, p, 1).try_cast("int"))
    return F.date_sub(F.to_date(F.from_utc_timestamp(now, PACIFIC)), days).cast("timestamp")


def iso_or_null(text: Column) -> Column:
    """The text itself if it can be read as a moment, else null."""
    return F.when(text.try_cast("timestamp").isNotNull(), text)


def posted_day_key(posted: Column, first_seen: Column) -> Column:
    """The printed day as yyyymmdd: in UTC if the text names a day only, else in Pacific time; 0 if nothing can be read."""
    iso = F.coalesce(posted, first_seen)
    moment = iso.try_cast("timestamp")
    shown = F.when(iso.rlike(_DAY_ONLY), moment).otherwise(F.from_utc_timestamp(moment, PACIFIC))
    return F.coalesce(F.date_format(shown, "yyyyMMdd").try_cast("int"), F.lit(0))


def moment_label(iso: Column) -> Column:
    """The moment as printed, or null: a day alone, or day and time in Pacific time."""
    moment = iso.try_cast("timestamp")
    return F.when(iso.rlike(_DAY_ONLY), F.date_format(moment, "MMM d, yyyy")).otherwise(F.date_format(F.from_utc_timestamp(moment, PACIFIC), "MMM d, yyyy, h:mm a"))


def posted_label(posted: Column, first_seen: Column) -> Column:
    seen = F.concat(F.lit("Not stated by the source, first seen "), moment_label(first_seen))
    return F.coalesce(moment_label(posted), seen, F.lit("Not stated by the source, first seen today"))
