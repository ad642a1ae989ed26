"""Mapping free-entered values to a canonical list (problem 1).

Distinct values are normalised, their candidates retrieved from a character n-gram inverted index of the list, scored by idf-weighted cosine, and
accepted above a threshold and a margin; an exact check of spelling distance and of the state that is named follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.identity import STATES
from jobweave.llm.common import bounded, spread
from jobweave.llm.places import Places, Whole
from jobweave.llm.strings import fold, grams
from jobweave.session import write_shared

#: The list goes to every task up to this size; a longer one is searched in parts of this size.
SHARD_ROWS = 20_000
COLUMNS = ["location_id", "city", "state_code", "state_name", "short_name"]


#: Two- and three-letter combinations of the signs of folded names; more than this is no list of names.
MAX_GRAMS = 200_000
MAX_STATES = 5_000


def _whole(rows: DataFrame) -> Whole:
    """What the parts of a long list must share, counted over all of it without collecting it."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = sorted({Places.plain(fold(x)).replace(" ", "") for c in ("city", "short_name") for x in b[c] if x})
            yield pd.DataFrame([(f, g) for f in forms for g in grams(f)], columns=["form", "gram"])

    pairs = write_shared(rows.select("city", "short_name").mapInPandas(counts, "form string, gram string").distinct(), "grams")
    df = {r[0]: r[1] for r in bounded(pairs.groupBy("gram").count(), MAX_GRAMS, "the n-grams of the list of places")}
    states = {}
    for code, name in bounded(rows.where("state_code is not null").select("state_code", "state_name").distinct(), MAX_STATES, "the list of states"):
        states |= {code.lower(): code.lower()} | ({fold(name): code.lower()} if name else {})
    known = sorted({*states, *STATES, *STATES.values()})
    words = rows.where("city is not null").select(F.explode(F.split(F.lower("city"), " ")).alias("w")).where(F.col("w").isin(known)).distinct()
    remote = rows.where("coalesce(city, '') = ''").agg(F.min("location_id")).first()[0]
    return Whole(df, pairs.select("form").distinct().count(), states, {r[0] for r in bounded(words, MAX_STATES, "the words of states")}, [] if remote is None else [remote])


def read_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """value, location_id (-1 if it names no entry, or several), places (all entries it may mean) of each distinct ``value``.

    A list of up to ``SHARD_ROWS`` goes to every task. A longer one is searched in parts of that size with the n-gram weights of the whole; each part tells the entries that
    a value's names meet in it, and the value is then read against the entries of all parts together, so the answer is that of one list.
    """
    rows = reference.select(*COLUMNS).where("location_id is not null").distinct()
    schema = "value string, location_id int, places array<int>"
    distinct = values.select("value").distinct()
    parts = -(-rows.count() // SHARD_ROWS)
    if parts <= 1:
        listed = [tuple(r) for r in rows.orderBy("location_id").collect()]

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places = Places(listed)
            for b in batches:
                got = [places.read(v) for v in b["value"]]
                yield pd.DataFrame({"value": b["value"], "location_id": [g[0] for g in got], "places": [list(g[1]) for g in got]})

        return spread(distinct).mapInPandas(read, schema)
    whole = _whole(rows)
    distinct = write_shared(distinct, "place-values")
    entry = F.struct(*COLUMNS).alias("entry")
    # each part of the list goes to its own tasks, and all values go to each part: a query set against all rows in blocks
    n = max(parts, distinct.sparkSession.sparkContext.defaultParallelism)
    listed = rows.withColumn("part", F.pmod(F.xxhash64(F.lower("city")), F.lit(parts)).cast("int"))
    asked = distinct.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(-(-n // parts))).cast("int"))
    slices = listed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(-(-n // parts) - 1))))

    def meet(key: tuple, vs: pd.DataFrame, ls: pd.DataFrame) -> pd.DataFrame:
        listed = sorted((tuple(None if isinstance(x, float) and x != x else x for x in r) for r in ls[COLUMNS].itertuples(index=False, name=None)), key=lambda r: r[0])
        places, out = Places(listed, whole), []
        for v in vs["value"]:
            places.met.clear()
            places.cache.clear()
            places.read(v)
            out += [(v, int(i)) for i in places.met]
        return pd.DataFrame(out, columns=["value", "location_id"])

    met = asked.groupBy("part", "slice").cogroup(slices.groupBy("part", "slice")).applyInPandas(meet, "value string, location_id int")
    entries = met.join(rows.select("location_id", entry), "location_id").groupBy("value").agg(F.collect_set("entry").alias("entries"))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for v, es in zip(b["value"], b["entries"]):
                listed = sorted((tuple(e[c] for c in COLUMNS) for e in (es if es is not None else [])), key=lambda r: r[0])
                got.append(Places(listed, whole).read(v))
            yield pd.DataFrame({"value": b["value"], "location_id": [g[0] for g in got], "places": [list(g[1]) for g in got]})

    return spread(distinct.join(entries, "value", "left")).mapInPandas(last, schema)


def map_locations(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``rows`` (with a column ``value``) and the entry that each value names: + location_id, places.

    Null and blank values give no row; a value that names no entry, several, or fits several equally has -1. Repeated rows stay repeated. Texts are
    read whole, however long. An empty reference maps everything to -1. Only ``value`` is read; columns of ``rows`` called
    location_id or places are replaced. Values shared by many rows cost one reading; the join back is split by adaptive execution.
    """
    filled = rows.drop("location_id", "places").where(F.trim("value") != "")
    return filled.join(read_values(filled, reference), "value")
