from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from jobweave.functions.instants import age_us, clean_space, instant_us
from jobweave.operators.instants import InstantDictionary, normalise_instants

UTC = timezone.utc
NY, LONDON = "America/New_York", "Europe/London"


def us(*a, tz=UTC, fold=0):
    moment = datetime(*a, tzinfo=tz, fold=fold)
    return round((moment.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = [
    ("2026-03-04T05:06:07Z", NY, "MDY", us(2026, 3, 4, 5, 6, 7)),
    ("  2026-03-04t05:06:07z ", NY, "MDY", us(2026, 3, 4, 5, 6, 7)),
    ("2026-03-04T05:06:07.123456+02:00", NY, "MDY", us(2026, 3, 4, 3, 6, 7, 123456)),
    ("2026-03-04 05:06:07 -0700", NY, "MDY", us(2026, 3, 4, 12, 6, 7)),
    ("2026-03-04", NY, "MDY", us(2026, 3, 4, tz=ZoneInfo(NY))),
    ("2026-07-11 20:38 America/New_York", "UTC", "YMD", us(2026, 7, 11, 20, 38, tz=ZoneInfo(NY))),
    ("20260304T050607Z", NY, "MDY", us(2026, 3, 4, 5, 6, 7)),
    ("1760475249642", NY, "MDY", 1760475249642 * 1000),
    ("1760475249", NY, "MDY", 1760475249 * 10**6),
    ("01/02/2026 3:20 PM", NY, "MDY", us(2026, 1, 2, 15, 20, tz=ZoneInfo(NY))),
    ("01/02/2026 12:05 AM", NY, "MDY", us(2026, 1, 2, 0, 5, tz=ZoneInfo(NY))),
    ("01/02/2026", LONDON, "DMY", us(2026, 2, 1, tz=ZoneInfo(LONDON))),
    ("31/05/2026", NY, "MDY", us(2026, 5, 31, tz=ZoneInfo(NY))),
    ("9/6/26", NY, "MDY", us(2026, 9, 6, tz=ZoneInfo(NY))),
    ("17.01.2026 18:25", "Europe/Berlin", "DMY", us(2026, 1, 17, 18, 25, tz=ZoneInfo("Europe/Berlin"))),
    ("09-Apr-2026", "Asia/Kolkata", "DMY", us(2026, 4, 9, tz=ZoneInfo("Asia/Kolkata"))),
    ("Fri, 17 Apr 2026 18:25:16 -0500", "UTC", "YMD", us(2026, 4, 17, 23, 25, 16)),
    ("April 10, 2026", NY, "MDY", us(2026, 4, 10, tz=ZoneInfo(NY))),
    ("Apr 2, 2026, 6:24 AM BST", NY, "MDY", us(2026, 4, 2, 5, 24)),
    ("Oct 30, 2025, 12:46 PM PDT", NY, "MDY", us(2025, 10, 30, 19, 46)),
    # a local time that occurs twice is the first, one that was skipped is read with the offset before
    ("2025-11-02 01:30:00", NY, "MDY", us(2025, 11, 2, 5, 30)),
    ("2026-03-08 02:30:00", NY, "MDY", us(2026, 3, 8, 7, 30)),
    ("unknown", NY, "MDY", None), ("N/A", NY, "MDY", None), ("", NY, "MDY", None), ("2026-13-45", NY, "MDY", None), ("31/31/2026", NY, "MDY", None),
    ("2026-03-04 05:06:07", "", "", None), ("2026-03-04 05:06:07", "Not/AZone", "MDY", None), ("5 Foo 2026", NY, "MDY", None), ("13:99 PM", NY, "MDY", None),
]


def test_instants_table(spark):
    df = spark.createDataFrame([(k, v, z, o) for k, (v, z, o, _) in enumerate(CASES)], "k int, v string, z string, o string")
    got = {r.k: r.i for r in df.select("k", instant_us(clean_space(F.col("v")), F.col("z"), F.col("o")).alias("i")).collect()}
    for k, case in enumerate(CASES):
        assert got[k] == case[3], case


@pytest.mark.parametrize("text,seconds", [("14h", 14 * 3600), ("17 hrs ago", 17 * 3600), ("3 weeks ago", 21 * 86400), ("Posted 5 Days Ago", 5 * 86400), ("5d", 5 * 86400), ("20d ago", 20 * 86400), ("Posted Yesterday", 86400), ("today", 0), ("soon", None), ("5", None)])
def test_ages(spark, text, seconds):
    got = spark.createDataFrame([(text,)], "v string").select(age_us(clean_space(F.col("v")))).first()[0]
    assert got == (None if seconds is None else seconds * 10**6)


ROWS = "posting_id long, a string, s string, zone string, date_order string, field_name string"


def _run(spark, rows, dictionary=None):
    df = spark.createDataFrame(rows, ROWS)
    out = normalise_instants(df, ["a", "s"], "s", "zone", "date_order", ["posting_id"], dictionary)
    return sorted((r.posting_id, r.field_name, r.instant_us) for r in out.collect())


def test_rows_ages_nulls_and_repeats(spark):
    rows = [
        (1, "2h", "2026-03-04T05:00:00Z", NY, "MDY", "x"), (1, "2h", "2026-03-04T05:00:00Z", NY, "MDY", "x"), (2, None, None, None, None, None),
        (3, "2h", None, NY, "MDY", "x"), (4, "Rolling", "  ", NY, "MDY", "x"), (5, "2026-01-01", "x" * 50_000, NY, "MDY", "x"),
    ]
    s, five = us(2026, 3, 4, 5), us(2026, 1, 1, tz=ZoneInfo(NY))
    assert _run(spark, rows) == [(1, "a", s - 7200 * 10**6)] * 2 + [(1, "s", s)] * 2 + [(5, "a", five)]
    assert _run(spark, []) == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "2026-03-04", None, "v", "z")], "zone long, s string, tz string, value string, date_order string").withColumn("tz", F.lit(NY)).withColumn("order", F.lit("MDY"))
    out = normalise_instants(df, ["s"], "s", "tz", "order", ["zone", "value", "date_order"]).collect()
    assert [tuple(r) for r in out] == [(1, "v", "z", "s", us(2026, 3, 4, tz=ZoneInfo(NY)))]


def test_dictionary_is_kept_and_grows(spark, tmp_path):
    path = str(tmp_path / "instants")
    first = InstantDictionary(spark, path)
    assert _run(spark, [(1, "2026-03-04", "2026-03-05T00:00:00Z", NY, "MDY", "")], first)[1][2] == us(2026, 3, 5)
    n = InstantDictionary(spark, path).read().count()
    again = _run(spark, [(2, "2026-03-04", "2026-03-06T00:00:00Z", NY, "MDY", "")], InstantDictionary(spark, path))
    assert again == [(2, "a", us(2026, 3, 4, tz=ZoneInfo(NY))), (2, "s", us(2026, 3, 6))]
    assert InstantDictionary(spark, path).read().count() == n + 1
