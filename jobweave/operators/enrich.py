"""Verdicts fetched once per posting, and postings filled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import extract_text


def pending(jobs: DataFrame, verdicts: DataFrame, ident: str = "id") -> DataFrame:
    """Postings that no verdict is stored for, not even an unreadable one: each is fetched once."""
    return jobs.join(verdicts.select(ident).distinct(), ident, "left_anti")


def page_verdicts(pages: DataFrame, verdict: Column, least: int = 400, summary: int = 280) -> DataFrame:
    """id, http_ok, verdict, summary of fetched pages (id, url, html): UNKNOWN for no address or a text below ``least`` characters; ``verdict`` reads ``text``."""
    t = pages.withColumn("text", extract_text(F.coalesce("html", F.lit(""))))
    web, long = F.coalesce(F.col("url").startswith("http"), F.lit(False)), F.length("text") >= least
    return t.select("id", (web & F.col("html").isNotNull()).alias("http_ok"), F.when(web & long, F.coalesce(verdict, F.lit("UNKNOWN"))).otherwise("UNKNOWN").alias("verdict"), F.when(web & long, F.left("text", F.lit(summary))).alias("summary"))


def apply_verdicts(jobs: DataFrame, verdicts: DataFrame, status: str, fill: list[str], ident: str = "id") -> DataFrame:
    """Postings with ``status`` taken from a verdict that is not UNKNOWN, and the ``fill`` columns taken from it where they are empty."""
    v = verdicts.select(ident, F.col("verdict").alias("_v"), *[F.col(c).alias(f"_{c}") for c in fill])
    j = jobs.join(v, ident, "left")
    j = j.withColumn(status, F.when(F.col("_v") != "UNKNOWN", F.col("_v")).otherwise(F.col(status)))
    for c in fill:
        j = j.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")))
    return j.drop("_v", *[f"_{c}" for c in fill])


def seen_addresses(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct apply addresses of stored postings."""
    return jobs.select("id").join(links.select(F.col("job_id").alias("id"), "direct_apply_url"), "id").where("direct_apply_url is not null").select("direct_apply_url").distinct()
