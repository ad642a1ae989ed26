"""Lifecycle state between batches: merges, expiry, cadence, claims, change data. State is a versioned snapshot; a pointer file names the current one."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import read_text, remove, write_text


class SnapshotStore:
    """A table kept as immutable snapshot folders and a pointer to the current one, replaced in one step. One writer at a time, guarded by a lock file.

    ``root`` is a folder that the driver and all executors share.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> DataFrame | None:
        pointer = read_text(self.spark, f"{self.root}/CURRENT")
        return self.spark.read.parquet(f"{self.root}/{json.loads(pointer)['snapshot']}") if pointer else None

    def commit(self, table: DataFrame, partition_by: str | None = None) -> DataFrame:
        name = f"snapshot-{uuid.uuid4().hex}"
        writer = table.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        write_text(self.spark, f"{self.root}/CURRENT", json.dumps({"snapshot": name}))
        return self.spark.read.parquet(f"{self.root}/{name}")

    @contextmanager
    def lock(self):
        """Held by one run; a second one fails at once."""
        try:
            write_text(self.spark, f"{self.root}/LOCK", "", once=True)
        except Py4JJavaError as e:
            raise FileExistsError(f"{self.root} is locked") from e
        try:
            yield self
        finally:
            remove(self.spark, f"{self.root}/LOCK")


def merge_state(previous: DataFrame, incoming: DataFrame, now: Column, repost_after_days: int = 30) -> DataFrame:
    """The next state: ``incoming`` (with ``stored_id``, null for a new posting) merged into ``previous``.

    New postings start at version 1. A known one is seen now and takes the incoming company, title, place, cycle and description where they are there; its key and source id stay. A missing status is OPEN; CLOSED sets ``closed_at`` once, OPEN clears it and
    stamps ``reopened_at`` if it was closed; a posting open again after more than ``repost_after_days`` is new to the reader (``sent_at`` cleared); a repost or a changed
    fingerprint raises the version. Of several incoming rows of one stored posting the last by id counts; two new rows
    that are one posting should be one before (``greedy_dedupe``).
    """
    one = incoming.groupBy(F.coalesce("stored_id", "id").alias("id")).agg(F.max_by(F.struct(*[F.col(c) for c in incoming.columns if c not in ("id", "status")], F.coalesce("status", F.lit("OPEN")).alias("status")), F.col("id")).alias("n"))
    p, n = previous.alias("p"), one.alias("x")
    j = p.join(n, F.col("p.id") == F.col("x.id"), "full")
    old, new = F.col("p.id").isNotNull(), F.col("x.id").isNotNull()
    opened, closed = new & (F.col("n.status") == "OPEN"), new & (F.col("n.status") == "CLOSED")
    back = opened & (F.col("p.status") == "CLOSED")
    repost = F.coalesce(back & (F.col("p.closed_at") < now - F.make_dt_interval(days=F.lit(repost_after_days))), F.lit(False))
    changed = F.coalesce((F.col("p.material_fingerprint") != "") & (F.col("p.material_fingerprint") != F.col("n.material_fingerprint")), F.lit(False))
    keep = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"n.{c}")).alias(c)
    take = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}")).alias(c)
    return j.select(
        F.coalesce("p.id", "x.id").alias("id"), keep("canonical_key"), take("canonical_url"), take("company"), take("title"), take("location"), take("cycle"), keep("source_job_id"), take("description"), F.when(new, F.col("n.status")).otherwise(F.col("p.status")).alias("status"),
        F.when(new, F.col("n.material_fingerprint")).otherwise(F.col("p.material_fingerprint")).alias("material_fingerprint"),
        F.when(~old, 1).otherwise(F.col("p.material_version") + F.when(new & (repost | changed), 1).otherwise(0)).alias("material_version"),
        F.coalesce("p.first_seen_at", now).alias("first_seen_at"), F.when(new, now).otherwise(F.col("p.last_seen_at")).alias("last_seen_at"),
        F.when(opened, F.lit(None)).when(closed, F.coalesce("p.closed_at", now)).otherwise(F.col("p.closed_at")).cast("timestamp").alias("closed_at"),
        F.when(back, now).otherwise(F.col("p.reopened_at")).alias("reopened_at"), F.when(repost, F.lit(None)).otherwise(F.col("p.sent_at")).cast("timestamp").alias("sent_at"),
    )


def merge_sources(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """job_id, source_name, source_job_id, source_url, updated_at under both unique keys: (source, id) and (job, url).

    A source's id that moved to another posting is re-pointed; among rows of one posting and address the latest stays.
    """
    both = previous.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.struct("updated_at", "_new", "job_id")
    key = F.coalesce(F.concat_ws("\u0001", "source_name", "source_job_id"), F.lit(""))
    named = both.where("source_job_id is not null").groupBy(key.alias("k")).agg(F.max_by(F.struct("job_id", "source_name", "source_job_id", "source_url", "updated_at"), rank).alias("r")).select("r.*")
    rest = both.where("source_job_id is null").select("job_id", "source_name", "source_job_id", "source_url", "updated_at")
    r2 = F.struct("updated_at", "source_name", F.coalesce("source_job_id", F.lit("")))
    return named.unionByName(rest).groupBy("job_id", "source_url").agg(F.max_by(F.struct("source_name", "source_job_id", "updated_at"), r2).alias("r")).select("job_id", "source_url", "r.*")


def close_stale(jobs: DataFrame, sightings: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Jobs with those CLOSED that are open, not seen for ``hours`` and not scraped by any source within them (``sightings``: job id, scraped_at)."""
    limit = now - F.make_dt_interval(hours=F.lit(hours))
    fresh = sightings.where(F.col("scraped_at") >= limit).select(F.col("job_id").alias("id"), F.lit(True).alias("_fresh")).distinct()
    stale = (F.col("status") == "OPEN") & (F.col("last_seen_at") < limit) & F.col("_fresh").isNull()
    out = jobs.join(fresh, "id", "left")
    return out.withColumn("closed_at", F.when(stale, now).otherwise(F.col("closed_at"))).withColumn("status", F.when(stale, "CLOSED").otherwise(F.col("status"))).drop("_fresh")


def due_sources(sources: DataFrame, watermarks: DataFrame, now: Column) -> DataFrame:
    """Sources (source_name, cadence_hours) that were never read or last at least their cadence ago."""
    j = sources.join(watermarks.select("source_name", "updated_at"), "source_name", "left")
    return j.where(F.col("updated_at").isNull() | (F.unix_micros(now) - F.unix_micros("updated_at") >= F.col("cadence_hours") * 3_600_000_000)).drop("updated_at")


def advance_watermarks(watermarks: DataFrame, runs: DataFrame, postings: DataFrame) -> DataFrame:
    """source_name, watermark, updated_at after a round: the latest posted_at of each successful source, else the end of its run; others stay."""
    good = runs.where("status = 'SUCCESS'").groupBy("source_name").agg(F.max("finished_at").alias("finished_at"))
    newest = postings.groupBy("source_name").agg(F.max("posted_at").alias("posted_at"))
    moved = good.join(newest, "source_name", "left").select("source_name", F.coalesce(F.col("posted_at").cast("string"), F.col("finished_at").cast("string")).alias("watermark"), F.col("finished_at").alias("updated_at"))
    return watermarks.join(moved, "source_name", "left_anti").unionByName(moved)


def page_changes(state: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next state, changes) of watched pages: url, content_hash, checked_at. A failed fetch (empty hash) keeps the last good one; a first sighting is no change."""
    j = state.alias("s").join(fetched.alias("f"), "url", "full")
    good = F.coalesce(F.col("f.content_hash"), F.lit("")) != ""
    following = j.select("url", F.when(good, F.col("f.content_hash")).otherwise(F.coalesce("s.content_hash", F.lit(""))).alias("content_hash"), F.coalesce("f.checked_at", "s.checked_at").alias("checked_at"))
    changed = j.where(good & (F.coalesce(F.col("s.content_hash"), F.lit("")) != "") & (F.col("s.content_hash") != F.col("f.content_hash"))).select("url", F.col("s.content_hash").alias("old_hash"), F.col("f.content_hash").alias("new_hash"))
    return following, changed


def claim_batch(store: SnapshotStore, batch_key: str, digest_hash: str, job_ids: list[str], now: str, reclaim_minutes: int = 60) -> str | None:
    """Claim a batch once: the key to use, or None if it was sent or is being sent. A claim that is abandoned or older than ``reclaim_minutes`` may be taken
    again, under its first key. The table is a log of batches and small; the caller holds the store's lock."""
    spark = store.spark
    schema = "batch_key string, digest_hash string, status string, job_ids array<string>, claimed_at timestamp, sent_at timestamp"
    table = store.current()
    table = spark.createDataFrame([], schema) if table is None else table
    moment = F.lit(now).cast("timestamp")
    held = table.where(F.col("digest_hash") == digest_hash)
    row = held.select("batch_key", ((F.col("status") == "ABANDONED") | ((F.col("status") == "CLAIMED") & (F.col("claimed_at") < moment - F.make_dt_interval(mins=F.lit(reclaim_minutes))))).alias("free")).first()
    if row is not None and not row["free"]:
        return None
    key = row["batch_key"] if row is not None else batch_key
    mine = spark.createDataFrame([(key, digest_hash, "CLAIMED", job_ids)], "batch_key string, digest_hash string, status string, job_ids array<string>").withColumn("claimed_at", moment).withColumn("sent_at", F.lit(None).cast("timestamp"))
    store.commit(table.where(F.col("digest_hash") != digest_hash).unionByName(mine))
    return key


def confirm_batch(store: SnapshotStore, batch_key: str, now: str) -> int:
    """Mark a claimed batch as sent; the number of batches marked (0 unless it was claimed)."""
    table = store.current()
    if table is None:
        return 0
    hit = (F.col("batch_key") == batch_key) & (F.col("status") == "CLAIMED")
    n = table.where(hit).count()
    if n:
        moment = F.lit(now).cast("timestamp")
        store.commit(table.withColumn("sent_at", F.when(hit, moment).otherwise(F.col("sent_at"))).withColumn("status", F.when(hit, "SENT").otherwise(F.col("status"))))
    return n


def stamp_sent(jobs: DataFrame, batches: DataFrame, batch_key: str) -> DataFrame:
    """Jobs with ``sent_at`` of a confirmed batch (batch_key, status, sent_at, job_ids) on every member of it; others stay, and a batch that was not sent stamps none."""
    members = batches.where((F.col("batch_key") == batch_key) & (F.col("status") == "SENT")).select(F.explode("job_ids").alias("id"), F.col("sent_at").alias("_sent")).groupBy("id").agg(F.max("_sent").alias("_sent"))
    return jobs.withColumn("_id", F.col("id").cast("string")).join(members.withColumnRenamed("id", "_id"), "_id", "left").withColumn("sent_at", F.coalesce("_sent", "sent_at")).drop("_sent", "_id")


def unsent(jobs: DataFrame) -> DataFrame:
    """Jobs that are open and were never sent."""
    return jobs.where("status = 'OPEN' and sent_at is null")


def unexpired(overrides: DataFrame, now: Column) -> DataFrame:
    """Overrides without an end (``expires_at``) or with one still to come."""
    return overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def restore_sent(jobs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Jobs with ``sent_at`` filled from the latest sent batch that holds them. ``deliveries``: id, status, sent_at, one row per batch and job, or per batch
    with an array ``job_ids``."""
    if "job_ids" in deliveries.columns:
        deliveries = deliveries.select(F.explode("job_ids").alias("id"), "status", "sent_at")
    sent = deliveries.where("status = 'SENT'").groupBy("id").agg(F.max("sent_at").alias("_sent"))
    return jobs.join(sent, "id", "left").withColumn("sent_at", F.coalesce("sent_at", "_sent")).drop("_sent")


def transition(previous: Column, incoming: Column) -> Column:
    """The pure state machine over struct(status, sent_at, material_version): a new posting starts at 1, one that opens again is unsent and one version on."""
    again = (previous["status"] == "CLOSED") & (incoming == "OPEN")
    return F.struct(incoming.alias("status"), F.when(previous.isNull() | again, F.lit(None)).otherwise(previous["sent_at"]).alias("sent_at"), F.when(previous.isNull(), 1).otherwise(previous["material_version"] + F.when(again, 1).otherwise(0)).alias("material_version"))
