"""What changed between full snapshots: set differences of compact hash arrays.

Every row is reduced to 24 bytes (two 64-bit key hashes and a row hash) in a hash bucket. Within a bucket numpy sorts the arrays of
two consecutive snapshots and takes their differences by ``searchsorted``; full values are fetched only for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from jobweave.functions.instants import clean_space
from jobweave.session import write_shared

#: Rows of all snapshots that one bucket should hold; a bucket is a task's working set (24 bytes a row and the copies of sorting).
BUCKET_ROWS = 1_000_000


def good_pairs(runs: DataFrame) -> DataFrame:
    """source, snapshot_no, previous: each good snapshot of a source and the good one before it.

    Good is a snapshot whose last run (by start, then end, then id) is SUCCESS. A source's first good snapshot has no row.
    """
    key = F.lower(clean_space(F.col("source_name")))
    last = runs.where("snapshot_no is not null and source_name is not null").groupBy(key.alias("source"), "snapshot_no").agg(F.max_by(F.upper(clean_space(F.col("status"))), F.struct("started_at", "finished_at", "run_id")).alias("status"))
    w = W.Window.partitionBy("source").orderBy("snapshot_no")
    return last.where("status = 'SUCCESS'").withColumn("previous", F.lag("snapshot_no").over(w)).where("previous is not null").select("source", "snapshot_no", "previous")


def _differences(now: tuple[np.ndarray, np.ndarray], old: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
    """Keys added, removed and changed; both sides are (sorted unique keys, row hashes)."""
    if len(now[0]) == 0 or len(old[0]) == 0:
        yield "added", now[0]
        yield "removed", old[0]
        return
    at = np.minimum(np.searchsorted(old[0], now[0]), len(old[0]) - 1)
    same = old[0][at] == now[0]
    yield "added", now[0][~same]
    yield "changed", now[0][same][old[1][at[same]] != now[1][same]]
    at = np.minimum(np.searchsorted(now[0], old[0]), len(now[0]) - 1)
    yield "removed", old[0][now[0][at] != old[0]]


def _keys(part: pd.DataFrame) -> np.ndarray:
    """The two key hashes of each row as one value of 16 bytes."""
    pair = np.empty((len(part), 2), dtype=">i8")
    pair[:, 0], pair[:, 1] = part["k1"], part["k2"]
    return pair.view("S16").ravel()


def _bucket_differences(pdf: pd.DataFrame) -> pd.DataFrame:
    """All differences of one bucket. Columns: source, snapshot_no, previous (of every good snapshot, -1 for the first), k1, k2, row; a marker row (without a row hash) says that a snapshot is good."""
    found: list[pd.DataFrame] = []
    empty = (np.array([], dtype="S16"), np.array([], dtype="int64"))
    for source, one in pdf.groupby("source", sort=False):
        arrays, before = {}, {}
        for (no, previous), part in one.groupby(["snapshot_no", "previous"], sort=False):
            part = part[~part["mark"]]
            keys = _keys(part)
            order = np.argsort(keys, kind="stable")
            arrays[no], before[no] = (keys[order], part["row"].to_numpy()[order]), previous
        for no, p in before.items():
            for kind, keys in _differences(arrays[no], arrays.get(p, empty)) if p >= 0 else ():
                pair = np.frombuffer(keys.tobytes(), dtype=">i8").reshape(-1, 2)
                found.append(pd.DataFrame({"source": source, "snapshot_no": no, "previous": p, "k1": pair[:, 0].astype("int64"), "k2": pair[:, 1].astype("int64"), "change_kind": kind}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["source", "snapshot_no", "previous", "k1", "k2", "change_kind"])
    return out.astype({"source": object, "snapshot_no": "int32", "previous": "int32", "k1": "int64", "k2": "int64", "change_kind": object})


def snapshot_changes(snapshots: DataFrame, runs: DataFrame, values: dict[str, Column], buckets: int | None = None, since: int | None = None, full: bool = False) -> DataFrame:
    """source, snapshot_no, source_job_id, change_kind of every posting that differs from the source's previous good snapshot; with ``full`` also old_<name> and new_<name> of all ``values``.

    With ``since`` only snapshots after that number are compared, and only they and the good ones before them are read.

    ``values`` are the normalised columns in which a difference is a change. Rows without a source, a snapshot or an id that is more than
    white space are no posting and give nothing. Of several rows of a posting in one snapshot the last ``delivered_at`` counts (ties: the
    higher ``material_version``, then the larger row hash, so the result is defined). Rows of snapshots that are not good are ignored.
    Empty tables give an empty result; extra columns are not read.
    """
    spark = snapshots.sparkSession
    source, ident = F.lower(clean_space(F.col("source_name"))), clean_space(F.col("source_job_id"))
    text = F.concat_ws("\u0001", *[F.concat(F.lit("="), F.coalesce(v, F.lit(""))) for v in values.values()])
    pairs = good_pairs(runs)
    pairs = pairs.where(F.col("snapshot_no") > since) if since is not None else pairs
    firsts = runs.where("snapshot_no is not null").select(F.lower(clean_space(F.col("source_name"))).alias("source"), "snapshot_no").distinct()
    # a first good snapshot is only an "old" side
    good = pairs.unionByName(pairs.groupBy("source").agg(F.min("previous").alias("snapshot_no")).withColumn("previous", F.lit(-1)))
    good = good.join(firsts, ["source", "snapshot_no"], "left_semi")
    good = write_shared(good, "good-snapshots")
    rows = snapshots.select(source.alias("source"), ident.alias("source_job_id"), "snapshot_no", "delivered_at", "material_version", F.xxhash64(text).alias("row")).where("source is not null and source_job_id <> ''")
    hashed = [F.xxhash64(F.lit(k), "source", "source_job_id").alias(f"k{k}") for k in (1, 2)]
    chosen = [v.alias(f"v_{c}") for c, v in values.items()] if full else []
    rows = rows.select("*", *hashed).join(F.broadcast(good) if runs.count() <= 100_000 else good, ["source", "snapshot_no"])
    one = rows.groupBy("source", "snapshot_no", "previous", "k1", "k2").agg(F.max_by("row", F.struct("delivered_at", "material_version", "row")).alias("row"), F.min("source_job_id").alias("source_job_id"))
    one = write_shared(one, "snapshot-rows")
    buckets = buckets or max(spark.sparkContext.defaultParallelism, one.count() // BUCKET_ROWS + 1)
    no_row = F.lit(0).cast("long")
    marks = good.select("source", "snapshot_no", "previous", no_row.alias("k1"), no_row.alias("k2"), no_row.alias("row"), F.lit(True).alias("mark"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    compact = one.select("source", "snapshot_no", "previous", "k1", "k2", "row", F.lit(False).alias("mark"), F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket")).unionByName(marks)
    differing = compact.groupBy("bucket").applyInPandas(_bucket_differences, "source string, snapshot_no int, previous int, k1 long, k2 long, change_kind string")
    differing = write_shared(differing, "differing-keys")
    # the full values of the differing keys only
    keys = ["source", "k1", "k2"]
    names = one.join(differing.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("source_job_id").alias("source_job_id"))
    found = differing.join(names, keys)
    if full:
        whole = snapshots.select(source.alias("source"), ident.alias("source_job_id"), "snapshot_no", "delivered_at", "material_version", F.xxhash64(text).alias("row"), *chosen).where("source is not null and source_job_id <> ''").select("*", *hashed)
        whole = whole.join(differing.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "snapshot_no").agg(F.max_by(F.struct(*[f"v_{c}" for c in values]), F.struct("delivered_at", "material_version", "row")).alias("v"))
        whole = write_shared(whole, "differing-values")
        for side, no in (("new", "snapshot_no"), ("old", "previous")):
            found = found.join(whole.select(*keys, F.col("snapshot_no").alias(no), *[F.col(f"v.v_{c}").alias(f"{side}_{c}") for c in values]), [*keys, no], "left")
    more = [f"{side}_{c}" for c in values for side in ("old", "new")] if full else []
    return found.select("snapshot_no", "source", "source_job_id", "change_kind", *more)
