"""Queries of the general data-preparation problems: p3 (snapshot changes) and p4 (instants)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.instants import clean_space
from jobweave.operators.instants import normalise_instants
from jobweave.operators.snapshots import snapshot_changes
from jobweave.session import table


def _snapshot_values() -> dict[str, Column]:
    text = lambda c: clean_space(F.col(c))
    status = lambda c: F.upper(F.coalesce(F.nullif(text(c), F.lit("")), F.lit("OPEN")))
    return {c: text(c) for c in ("title", "location", "direct_apply_url")} | {c: status(c) for c in ("status", "state_status")}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder, False).select("snapshot_no", "source_name", "source_job_id", "change_kind")


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """The changes with what each field was and is."""
    return _changes(spark, folder, True)


def _changes(spark: SparkSession, folder: str, full: bool) -> DataFrame:
    values = _snapshot_values()
    found = snapshot_changes(table(spark, folder, "job_snapshots"), table(spark, folder, "source_runs"), values, full=full)
    names = table(spark, folder, "source_profiles").select(F.lower(clean_space(F.col("source_name"))).alias("source"), "source_name")
    more = [F.coalesce(F.col(f"{side}_{c}"), F.lit("")).alias(f"{side}_{c}") for c in values for side in ("old", "new")] if full else []
    return found.join(names, "source", "left").select("snapshot_no", F.coalesce("source_name", "source").alias("source_name"), "source_job_id", "change_kind", *more)


P3_SQL = """
with r as (select lower(trim(source_name)) source, snapshot_no, arg_max(upper(trim(status)), (started_at, finished_at, run_id)) status from source_runs group by 1, 2),
good as (select source, snapshot_no, lag(snapshot_no) over (partition by source order by snapshot_no) previous from r where status = 'SUCCESS'),
n as (select lower(trim(regexp_replace(source_name, '[\\s\\p{Z}]+', ' ', 'g'))) source, trim(regexp_replace(source_job_id, '[\\s\\p{Z}]+', ' ', 'g')) id, snapshot_no, delivered_at, material_version,
  trim(regexp_replace(coalesce(title, ''), '[\\s\\p{Z}]+', ' ', 'g')) t, trim(regexp_replace(coalesce(location, ''), '[\\s\\p{Z}]+', ' ', 'g')) l, trim(regexp_replace(coalesce(direct_apply_url, ''), '[\\s\\p{Z}]+', ' ', 'g')) u,
  upper(coalesce(nullif(trim(regexp_replace(status, '[\\s\\p{Z}]+', ' ', 'g')), ''), 'OPEN')) s, upper(coalesce(nullif(trim(regexp_replace(state_status, '[\\s\\p{Z}]+', ' ', 'g')), ''), 'OPEN')) ss from job_snapshots),
d as (select * from (select *, row_number() over (partition by source, id, snapshot_no order by delivered_at desc, material_version desc) rn from n where id <> '') where rn = 1),
a as (select g.source, g.snapshot_no no, d.id, d.t, d.l, d.u, d.s, d.ss from good g join d using (source, snapshot_no) where previous is not null),
b as (select g.source, g.snapshot_no no, d.id, d.t, d.l, d.u, d.s, d.ss from good g join d on d.source = g.source and d.snapshot_no = g.previous),
x as (select coalesce(a.source, b.source) source, coalesce(a.no, b.no) snapshot_no, coalesce(a.id, b.id) source_job_id,
  a.t nt, a.l nl, a.u nu, a.s ns, a.ss nss, b.t ot, b.l ol, b.u ou, b.s os, b.ss oss, case when b.id is null then 'added' when a.id is null then 'removed' when (a.t, a.l, a.u, a.s, a.ss) is distinct from (b.t, b.l, b.u, b.s, b.ss) then 'changed' end change_kind
  from a full join b on a.source = b.source and a.no = b.no and a.id = b.id)
select snapshot_no, coalesce(p.source_name, x.source) source_name, source_job_id, change_kind from x left join source_profiles p on lower(p.source_name) = x.source where change_kind is not null
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    profiles = table(spark, folder, "source_profiles").select("source_name", "default_zone", "date_order")
    rows = table(spark, folder, "raw_postings").select("posting_id", "source_name", "posted_at", "scraped_at").join(profiles, "source_name", "left")
    return normalise_instants(rows, ["posted_at", "scraped_at"], "scraped_at", "default_zone", "date_order", ["posting_id"]).select("posting_id", "field_name", "instant_us")


P3_VALUES_SQL = P3_SQL.replace("source_job_id, change_kind from x", "source_job_id, change_kind, " + ", ".join(f"coalesce({side[0]}{k}, '') {side}_{c}" for c, k in (("title", "t"), ("location", "l"), ("direct_apply_url", "u"), ("status", "s"), ("state_status", "ss")) for side in ("old", "new")) + " from x")

QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p4_found": p4_found}
SQL = {"p3_found": P3_SQL, "p3_values": P3_VALUES_SQL}
