"""Duplicates on alternative keys, groups of one requisition, and fair caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from jobweave.session import discard, write_shared

#: Keys of undecided rows that one task scans; about 100 bytes each.
SCAN_KEYS = 200_000


def distinct_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; rows whose keys are all null are one key like any other."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def alternative_keys(url: Column, company: Column, source_id: Column, title: Column, location: Column, cycle: Column, bucket: Column, signature: Column, key: Column) -> Column:
    """The up to five keys under which a posting may be met again; parts that are missing give no key."""
    url_key = F.when(url.startswith("http"), F.concat(F.lit("url:"), url))
    req = F.when(F.trim(source_id) != "", F.concat_ws("|", F.concat(F.lit("req:"), company), F.trim(source_id)))
    tup = F.concat_ws("|", F.concat(F.lit("tuple:"), company), title, location, cycle)
    sig = F.when(signature != "", F.concat_ws("|", F.concat(F.lit("sig:"), company), cycle, bucket, signature))
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("key:"), key), url_key, req, tup, sig)))


def greedy_dedupe(rows: DataFrame, ident: str, keys: str, order: list) -> DataFrame:
    """Rows that no better kept row shares a key with, as a sequential scan in ``order`` would keep them.

    This is the lexicographically first maximal independent set, not connected components: a row that is dropped claims none of its keys. Each round keeps
    the rows that are the best undecided one under all their keys and drops the undecided rows that share a key with them, so every chain of conflicts
    shrinks; keys that only one row has take no part. Keys are aggregated by ``min`` on the map side, so a key that a third of all rows share is
    no burden. Once no more than ``SCAN_KEYS`` keys of rows are undecided, one task scans them in order, which gives the same. Rows without any key are kept. Ties in ``order`` are broken by
    ``ident``, which must be unique.
    """
    ranked = rows.select(ident, keys, F.struct(*order, F.col(ident)).alias("_rank"))
    every = write_shared(ranked.select(ident, "_rank", F.explode(keys).alias("_key")), "dedupe-keys")
    shared = every.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    pending = conflicts = write_shared(every.join(shared, "_key"), "dedupe-keys")
    kept = rows.select(ident).join(pending.select(ident).distinct(), ident, "left_anti")
    schema = f"`{ident}` {rows.schema[ident].dataType.simpleString()}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order, the keys of one after another."""
        taken, mine, current, out = set(), [], None, []
        for b in batches:
            for one, key in zip(b[ident].tolist(), b["_key"].tolist()):
                if one != current:
                    if current is not None and taken.isdisjoint(mine):
                        taken.update(mine)
                        out.append(current)
                    current, mine = one, []
                mine.append(key)
        if current is not None and taken.isdisjoint(mine):
            out.append(current)
        yield pd.DataFrame({ident: out})

    while True:  # a round decides the best undecided row at least
        n = pending.count()
        if n <= SCAN_KEYS:
            return rows.join(kept.unionByName(pending.repartition(1).sortWithinPartitions("_rank").select(ident, "_key").mapInPandas(scan, schema)) if n else kept, ident, "left_semi")
        best = pending.groupBy("_key").agg(F.min("_rank").alias("_best"))
        state = pending.join(best, "_key").groupBy(ident).agg(F.min(F.when(F.col("_rank") == F.col("_best"), 1).otherwise(0)).alias("wins"))
        winners = write_shared(state.where("wins = 1").select(ident), "dedupe-kept")
        kept = kept.unionByName(winners)
        claimed = pending.join(winners, ident, "left_semi").select("_key").distinct()
        losers = pending.join(claimed, "_key", "left_semi").select(ident).distinct()
        left = write_shared(pending.join(losers, ident, "left_anti"), "dedupe-keys")
        if pending is not conflicts:
            discard(pending)
        pending = left


def merged_location(places: Column) -> Column:
    """Distinct places in their order: up to three in full, else the first three and how many more."""
    d = F.array_distinct(F.filter(places, lambda p: p.isNotNull() & (p != "")))
    return F.when(F.size(d) <= 3, F.array_join(d, " · ")).otherwise(F.concat(F.array_join(F.slice(d, 1, 3), " · "), F.lit(" +"), (F.size(d) - 3).cast("string"), F.lit(" more")))


def requisition_key(group: Column, ident: str) -> Column:
    """The group of a row; a null one is a requisition of its own."""
    return F.coalesce(group, F.concat(F.lit("alone:"), F.col(ident).cast("string")))


def collapse(rows: DataFrame, group: Column, ident: str, order: list, location: str, display: list[str]) -> DataFrame:
    """One row per requisition: requisition, the ``display`` columns of its best row, merged_location, n_members. ``order`` ranks the members, ties by id.

    Everything is partial aggregation: no group is gathered. Of a group only the distinct places come together, which are few however many rows it has.
    """
    keyed = rows.withColumn("requisition", requisition_key(group, ident))
    rank = F.struct(*order, F.col(ident))
    best = keyed.groupBy("requisition").agg(F.min_by(F.struct(*display), rank).alias("d"), F.count("*").cast("int").alias("n_members"))
    places = keyed.where(F.col(location) != "").groupBy("requisition", F.col(location).alias("place")).agg(F.min(rank).alias("rank"))
    named = places.groupBy("requisition").agg(F.array_sort(F.collect_list(F.struct("rank", "place"))).alias("ps"))
    place = F.coalesce(merged_location(F.transform("ps", lambda x: x["place"])), F.lit(""))
    return best.join(named, "requisition", "left").select("requisition", *[F.col(f"d.{c}").alias(c) for c in display], place.alias("merged_location"), "n_members")


def members(rows: DataFrame, group: Column, ident: str, order: list, kept: DataFrame | None = None) -> DataFrame:
    """requisition, id, member_no (0 is the one displayed) of the rows of the ``kept`` requisitions, or of all. A large group is sorted on disk, never held."""
    keyed = rows.withColumn("requisition", requisition_key(group, ident))
    keyed = keyed.join(kept.select("requisition"), "requisition", "left_semi") if kept is not None else keyed
    w = W.Window.partitionBy("requisition").orderBy(*order, ident)
    return keyed.select("requisition", F.col(ident).alias("id"), (F.row_number().over(w) - 1).alias("member_no"))


class Order:
    """A sort key that knows its column and direction."""

    def __init__(self, column: Column, descending: bool = False):
        self.column, self.descending = column, descending

    def of(self, column: Column) -> Column:
        return column.desc() if self.descending else column.asc()


def fair_top(rows: DataFrame, company: str, order: list[Order], limit: int) -> DataFrame:
    """Up to ``limit`` rows with ``deal_no``, dealt one per company and round, companies in the order of their best row, then by name.

    A row's round is its rank within its company. Only the first ``limit`` rows of a company can be dealt, and the filter on the rank lets Spark cut a
    company's rows before they are shuffled; what is left is at most ``limit`` rows per company, of which the final sort keeps ``limit``.
    """
    w = W.Window.partitionBy(company).orderBy(*[o.of(o.column) for o in order])
    ranked = rows.withColumn("_round", F.row_number().over(w)).where(F.col("_round") <= limit)
    tops = [f"_top{k}" for k in range(len(order))]
    for name, o in zip(tops, order):
        ranked = ranked.withColumn(name, F.first(o.column).over(w))
    deal = [F.col("_round"), *[o.of(F.col(t)) for t, o in zip(tops, order)], F.col(company)]
    return ranked.orderBy(*deal).limit(limit).withColumn("deal_no", F.row_number().over(W.Window.orderBy(*deal))).drop("_round", *tops)


def cap_groups(groups: DataFrame, key: str, company: str, order: list[Order], limit: int) -> DataFrame:
    """The groups that a fair cap keeps; all of them if there are no more than ``limit``. The limit may be 0."""
    return groups.join(fair_top(groups, company, order, limit).select(key), key, "left_semi")
