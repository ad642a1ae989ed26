"""Aggregates and reports of runs, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def source_counts(rows: DataFrame, accepted: Column) -> DataFrame:
    """source_name, accepted, rejected."""
    return rows.groupBy("source_name").agg(F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, reason: str, kept: str) -> DataFrame:
    """One row: raw, eligible, rejected, deduplicated (eligible rows that were not kept)."""
    eligible = F.col(reason).isNull()
    return rows.agg(F.count("*").alias("raw"), F.count_if(eligible).alias("eligible"), F.count_if(~eligible).alias("rejected"), F.count_if(eligible & ~F.col(kept)).alias("deduplicated"))


def batch_counts(rows: DataFrame) -> DataFrame:
    """One row: raw, accepted, rejected, deduplicated, applied_excluded of rows with booleans rejected, excluded, unique, accepted.

    Rejected counts the excluded rows too; deduplicated are the rows that are neither rejected nor excluded and that another row stands for.
    """
    open_ = ~F.col("rejected") & ~F.col("excluded")
    return rows.agg(F.count("*").alias("raw"), F.count_if("accepted").alias("accepted"), F.count_if(~open_).alias("rejected"), F.count_if(open_ & ~F.col("unique")).alias("deduplicated"), F.count_if(~F.col("rejected") & F.col("excluded")).alias("applied_excluded"))


def metrics_of(runs: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """``runs`` with numbers read from a column of JSON text; what is missing or no number is null."""
    return runs.withColumns({f: F.get_json_object(column, f"$.{f}").try_cast("double") for f in fields})


def coverage(seen: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: wanted, found, percent (rounded; 0 of an empty list)."""
    hit = wanted.select(key).distinct().join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("_seen").alias("found")).select("wanted", "found", F.when(F.col("wanted") == 0, 0).otherwise(F.round(100 * F.col("found") / F.col("wanted"))).cast("int").alias("percent"))


def silent_sources(runs: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Sources whose successful runs of the last hours fetched nothing: source_name, n_runs."""
    recent = runs.where((F.col("status") == "SUCCESS") & (F.col("started_at") > now - F.make_dt_interval(hours=F.lit(hours))))
    return recent.groupBy("source_name").agg(F.count("*").alias("n_runs"), F.sum("fetched_count").alias("fetched")).where("fetched = 0").select("source_name", "n_runs")


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def delivery_state(batches: DataFrame, limit: int = 20) -> DataFrame:
    return batches.select("batch_key", "status", F.size("job_ids").alias("n_jobs"), "claimed_at", "sent_at").orderBy(F.col("claimed_at").desc()).limit(limit)


def page_run_status(pages: DataFrame) -> DataFrame:
    """One row per source: FAILED if it watched pages and could read none."""
    return pages.groupBy("source_name").agg(F.when((F.count("*") > 0) & (F.count_if(F.col("content_hash") != "") == 0), "FAILED").otherwise("SUCCESS").alias("status"))


def rotate(items: DataFrame, key: str, priority: str, slot: int, count: int, high: int = 10) -> DataFrame:
    """The cohort of a slot: half (rounded up) from items of high priority, the rest from the others, each a slice that moves on with every slot.

    If there are no more than ``count`` items, all of them. A slice longer than its list wraps and repeats items. ``cohort_no`` is the place in the cohort.
    """
    w = W.Window.partitionBy("_high").orderBy(key)
    sizes = items.agg(F.count("*").alias("n"), F.count_if(F.col(priority) >= high).alias("h")).first()
    n, h = sizes["n"], sizes["h"]
    if n <= count:
        return items.withColumn("cohort_no", F.row_number().over(W.Window.orderBy(key)) - 1)
    first = min(-(-count // 2), h)
    numbered = items.withColumn("_high", F.col(priority) >= high).withColumn("_at", F.row_number().over(w) - 1)
    wanted = [(True, (slot * first + k) % h, k) for k in range(first)] + ([(False, (slot * (count - first) + k) % (n - h), first + k) for k in range(count - first)] if n > h else [])
    slots = items.sparkSession.createDataFrame(wanted, "_high boolean, _at int, cohort_no int")
    return numbered.join(slots, ["_high", "_at"]).drop("_high", "_at")
