"""A batch end to end: raw postings to the rows of a digest, the report and the rendered text, once or against the state of earlier batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import identity, text, url
from jobweave.functions.rules import season_cycle
from jobweave.operators import dedupe, joins, metrics, sinks, state
from jobweave.operators.dedupe import Order
from jobweave.session import table, write_shared


def classify(raw: DataFrame, aliases: DataFrame, reason: Column | None = None, points: Column | None = None) -> DataFrame:
    """Raw postings with their keys, cycle, score and the reason for which they are out (null: in). A narrow projection but for the alias lookup.

    Which rows are out, and what earns points, is the caller's; without them only rows that are closed or lack a title or company are out.
    """
    link = url.canonicalize_url(F.coalesce("direct_apply_url", "source_url"))
    r = raw.withColumn("company_key", identity.company_key(F.col("company"))).withColumn("canonical_url", link)
    r = joins.resolve_alias(r, "company_key", aliases, "display_company").withColumn("normalized_company", text.normalize_text(F.col("display_company")))
    r = r.withColumn("normalized_title", text.normalize_text(F.col("title"))).withColumn("place", text.squeeze(F.coalesce("location", F.lit("Unspecified"))))
    r = r.withColumn("normalized_location", text.normalize_text(F.col("place"))).withColumn("cycle", F.coalesce(season_cycle(F.col("title")), F.col("cycle_hint"), F.lit("")))
    own = F.when(F.upper(F.trim(F.coalesce("status", F.lit("OPEN")))) == "CLOSED", "closed").when(F.coalesce(F.col("normalized_title"), F.lit("")) == "", "no_title").when(F.coalesce(F.col("normalized_company"), F.lit("")) == "", "no_company")
    r = r.withColumn("reason", F.coalesce(own, reason) if reason is not None else own).withColumn("score", points if points is not None else F.lit(0))
    key = identity.canonical_key(F.col("source_name"), F.col("source_job_id"), F.col("canonical_url"), F.col("normalized_company"), F.col("normalized_title"), F.col("normalized_location"), F.col("cycle"))
    return r.withColumn("canonical_key", key).withColumn("signature", identity.title_signature(F.col("normalized_title"))).withColumn("requisition", identity.requisition_signature(F.col("normalized_company"), F.col("normalized_title"), F.col("cycle")))


KEPT = [
    "source_name", "source_job_id", "title", "display_company", "place", "direct_apply_url", "source_url", "description", "canonical_url", "normalized_company", "normalized_title", "normalized_location", "cycle", "canonical_key",
    "signature", "requisition", "reason", "score",
]


@dataclass
class Batch:
    """The stages of a batch, each computed when it is first asked for; what several stages read is written once.

    ``raw`` goes through exclusion, deduplication, suppression of what was sent, grouping, the fair cap, sections and rendering. ``only``, if given, maps the unique rows to those that may be
    reported (a persistent run leaves out what was reported before).
    """

    raw: DataFrame
    ident: str
    aliases: DataFrame
    exclusions: DataFrame
    sent: DataFrame
    section: Column
    section_order: list[str]
    limit: int
    reason: Column | None = None
    points: Column | None = None
    only: Callable[[DataFrame], DataFrame] | None = None
    runs: DataFrame | None = None
    changes: DataFrame | None = None
    order: list[Column] = field(default_factory=lambda: [-F.col("score")])

    @cached_property
    def classified(self) -> DataFrame:
        """Rows with their keys and the reason for which they are out."""
        return write_shared(classify(self.raw, self.aliases, self.reason, self.points).select(self.ident, *KEPT), "classified")

    @cached_property
    def excluded(self) -> DataFrame:
        """The ids of rows that were applied to."""
        return write_shared(joins.excluded_ids(self.classified.where("reason is null"), self.ident, "normalized_company", "normalized_title", "canonical_url", "source_job_id", self.exclusions), "excluded")

    @cached_property
    def unique(self) -> DataFrame:
        eligible = self.classified.where("reason is null").join(self.excluded, self.ident, "left_anti")
        bucket = identity.location_bucket(F.col("place"), F.col("normalized_location"))
        keys = dedupe.alternative_keys(F.col("canonical_url"), F.col("normalized_company"), F.col("source_job_id"), F.col("normalized_title"), F.col("normalized_location"), F.col("cycle"), bucket, F.col("signature"), F.col("canonical_key"))
        ranked = eligible.withColumn("keys", keys).withColumn("r1", -url.apply_link_rank(F.col("canonical_url"))).withColumn("r2", -F.col("score"))
        return write_shared(dedupe.greedy_dedupe(ranked, self.ident, "keys", [F.col("r1"), F.col("r2")]).drop("keys", "r1", "r2"), "unique")

    @cached_property
    def new(self) -> DataFrame:
        return self.only(self.unique) if self.only else self.unique

    @cached_property
    def fresh(self) -> DataFrame:
        return joins.drop_sent(self.new, F.col("requisition"), self.sent)

    @cached_property
    def groups(self) -> DataFrame:
        shown = [self.ident, "score", "normalized_company", "display_company", "title", "direct_apply_url", "source_url", "source_name", "cycle", "description"]
        groups = dedupe.collapse(self.fresh, F.col("requisition"), self.ident, self.order, "place", shown)
        return write_shared(dedupe.cap_groups(groups, "requisition", "normalized_company", [Order(F.col("score"), True), Order(F.col(self.ident))], self.limit), "kept-groups")

    @cached_property
    def members(self) -> DataFrame:
        return dedupe.members(self.fresh, F.col("requisition"), self.ident, self.order, self.groups)

    @cached_property
    def report(self) -> DataFrame:
        """One row: raw, accepted (members of the digest), rejected, deduplicated, applied_excluded."""
        flag = lambda df, c, name: df.select(F.col(c).alias(self.ident), F.lit(True).alias(name))
        rows = self.classified.select(self.ident, F.col("reason").isNotNull().alias("rejected"))
        for df, c, name in ((self.excluded, self.ident, "excluded"), (self.unique, self.ident, "unique"), (self.members, "id", "accepted")):
            rows = rows.join(flag(df, c, name), self.ident, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return metrics.batch_counts(rows)

    @cached_property
    def reasons(self) -> DataFrame:
        """reason, n of the rows that are out, ``already_applied`` and ``requisition_already_sent`` among them."""
        own = self.classified.where("reason is not null").select("reason")
        applied = self.excluded.select(F.lit("already_applied").alias("reason"))
        told = self.new.join(self.fresh.select(self.ident), self.ident, "left_anti").select(F.lit("requisition_already_sent").alias("reason"))
        return metrics.histogram(own.unionByName(applied).unionByName(told), "reason")

    @cached_property
    def digest(self) -> DataFrame:
        link = sinks.apply_links(F.col("direct_apply_url"), F.col("source_url"))
        shown = sinks.sections(self.groups, self.section, self.section_order).select(
            "section", "section_no", "title", F.col("display_company").alias("company"), F.col("merged_location").alias("place"), link[0]["label"].alias("label"), link[0]["url"].alias("url"), "score", F.col(self.ident).alias("ident"), "cycle", "source_name",
            text.short_summary(F.col("description")).alias("summary"),
        )
        notes = sinks.degraded(self.runs) if self.runs is not None else None
        return sinks.render_digest(shown, [(-F.col("score")).alias("o1"), F.lower("company").alias("o2"), F.col("company").alias("o3"), F.col("ident").alias("o4")], changes=self.changes, notes=notes)


@dataclass
class Stores:
    """What a persistent run keeps: postings, the rows of their sources, batches. One run at a time holds the lock of ``jobs``."""

    jobs: state.SnapshotStore
    sources: state.SnapshotStore
    batches: state.SnapshotStore


_JOB = "id string, canonical_key string, canonical_url string, company string, title string, location string, cycle string, source_job_id string, description string, status string, material_fingerprint string, material_version int, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, reopened_at timestamp, sent_at timestamp"
_SOURCE = "job_id string, source_name string, source_job_id string, source_url string, updated_at timestamp"


def run_persistent(batch: Batch, stores: Stores, now: str) -> str | None:
    """Match the unique rows of ``batch`` with what is stored, merge, close what is stale, leave out what was sent, and claim the batch: its key, or None if there is nothing new or it is claimed already.

    A posting's id is the canonical key under which it was first met. Afterwards ``batch`` reports the new rows only. Nothing is marked as sent before ``confirm``.
    """
    spark, moment = stores.jobs.spark, F.lit(now).cast("timestamp")
    with stores.jobs.lock():
        jobs = stores.jobs.current() or spark.createDataFrame([], _JOB)
        sources = stores.sources.current() or spark.createDataFrame([], _SOURCE)
        place = F.coalesce("place", F.lit("Unspecified"))
        incoming = batch.unique.select(
            F.col("canonical_key").alias("id"), "canonical_key", "canonical_url", F.col("normalized_company").alias("company"), F.col("normalized_title").alias("title"), F.col("normalized_location").alias("location"), "cycle", "source_job_id", "description",
            F.lit("OPEN").alias("status"), identity.material_fingerprint(F.col("title"), place, F.col("cycle")).alias("material_fingerprint"),
        )
        links = sources.select(F.col("job_id").alias("stored_id"), F.col("source_url").alias("url"), "source_job_id")
        matched = write_shared(joins.match_stored(incoming, jobs, links), "matched")
        incoming = incoming.join(matched, "id", "left")
        rows = batch.unique.join(matched.withColumnRenamed("id", "canonical_key"), "canonical_key", "left").select(F.coalesce("stored_id", "canonical_key").alias("job_id"), "source_name", F.nullif(F.trim("source_job_id"), F.lit("")).alias("source_job_id"), F.coalesce("canonical_url", "source_url").alias("source_url"), moment.alias("updated_at"))
        sources = stores.sources.commit(state.merge_sources(sources, rows))
        merged = state.merge_state(jobs, incoming, moment)
        jobs = stores.jobs.commit(state.close_stale(merged, sources.select("job_id", F.col("updated_at").alias("scraped_at")), moment))
        told = jobs.where("sent_at is not null").select(identity.requisition_signature(F.col("company"), F.col("title"), F.col("cycle")).alias("signature"))
        batch.sent = batch.sent.unionByName(told)
        ids = matched.select(F.col("id").alias("canonical_key"), "stored_id")
        open_ = state.unsent(jobs).select(F.col("id").alias("_job"))
        batch.only = lambda unique: unique.join(ids, "canonical_key", "left").withColumn("_job", F.coalesce("stored_id", "canonical_key")).join(open_, "_job", "left_semi").drop("stored_id", "_job")
        for name in ("new", "fresh", "groups", "members"):
            batch.__dict__.pop(name, None)
        # the cap bounds the batch
        keys = batch.members.join(batch.unique.select(F.col(batch.ident).alias("id"), "canonical_key"), "id").join(ids, "canonical_key", "left").select(F.coalesce("stored_id", "canonical_key").alias("id"))
        job_ids = sorted(r["id"] for r in keys.collect())
        pages = [f"page:{r['url']}" for r in batch.changes.select("url").collect()] if batch.changes is not None else []
        if not job_ids and not pages:
            return None
        ident = sorted(job_ids + pages)
        key, digest = spark.range(1).select(identity.batch_key(F.array(*map(F.lit, ident)), moment), F.sha2(F.lit("|".join(ident)), 256)).first()
        return state.claim_batch(stores.batches, key, digest, job_ids, now)


def confirm(stores: Stores, batch_key: str, now: str) -> int:
    """Mark a claimed batch and all its postings as sent; the number of batches marked."""
    with stores.jobs.lock():
        n = state.confirm_batch(stores.batches, batch_key, now)
        if n:
            stores.jobs.commit(state.stamp_sent(stores.jobs.current(), stores.batches.current(), batch_key))
        return n


def run_batch(raw: DataFrame, ident: str, aliases: DataFrame, exclusions: DataFrame, sent: DataFrame, section: Column, section_order: list[str], limit: int, reason: Column | None = None, points: Column | None = None, runs: DataFrame | None = None) -> Batch:
    """A batch against nothing but a list of what was sent."""
    return Batch(raw, ident, aliases, exclusions, sent, section, section_order, limit, reason, points, runs=runs)


def _batch(spark: SparkSession, d: str) -> Batch:
    aliases = joins.alias_table(table(spark, d, "company_aliases").select(F.col("alias_normalized").alias("alias"), F.col("canonical_company").alias("canonical")))
    sent = table(spark, d, "classified_jobs").where("batch_no <= 5").select(identity.requisition_signature(F.col("normalized_company"), F.col("normalized_title"), F.col("cycle")).alias("signature"))
    raw = table(spark, d, "raw_postings").join(table(spark, d, "source_profiles").select("source_name", "kind"), "source_name", "left")
    section = F.when(F.col("direct_apply_url").isNotNull(), "With a form").otherwise("Listed only")
    points = F.when(F.col("kind") == "board", 20).otherwise(0) + F.when(F.col("direct_apply_url").isNotNull(), 10).otherwise(0)
    return run_batch(raw, "posting_id", aliases, table(spark, d, "applied_exclusions"), sent, section, ["With a form", "Listed only"], 100, points=points, runs=table(spark, d, "source_runs").where("snapshot_no = 7"))


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).report


def batch_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).reasons


def batch_members(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).members


def batch_digest(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).digest


QUERIES = {"batch_report": batch_report, "batch_reasons": batch_reasons, "batch_members": batch_members, "batch_digest": batch_digest}
SQL: dict[str, str] = {}
