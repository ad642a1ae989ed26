"""Record types of the feed, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _fields(*names: str, required: tuple[str, ...] = ()) -> list[T.StructField]:
    return [T.StructField(n, _S, n not in required) for n in names]


RAW_POSTING = T.StructType(_fields("source_name", "source_job_id", "title", "company", "location", "posted_at", "description", "employment_type", "source_url", "direct_apply_url", "scraped_at", "cycle_hint", "status", "raw"))
RAW_COLUMNS = RAW_POSTING.fieldNames()
REQUIRED = ["source_name", "title", "company", "source_url", "scraped_at"]
EXCLUSION = T.StructType(_fields("page_id", "company_normalized", "title_normalized", "canonical_url", "source_job_id"))
JOB_STATE = T.StructType([
    T.StructField("id", _S), T.StructField("canonical_key", _S), T.StructField("canonical_url", _S), T.StructField("company", _S), T.StructField("title", _S), T.StructField("location", _S), T.StructField("cycle", _S),
    T.StructField("source_job_id", _S), T.StructField("description", _S), T.StructField("status", _S), T.StructField("material_fingerprint", _S), T.StructField("material_version", T.IntegerType()),
    T.StructField("first_seen_at", T.TimestampType()), T.StructField("last_seen_at", T.TimestampType()), T.StructField("closed_at", T.TimestampType()), T.StructField("reopened_at", T.TimestampType()), T.StructField("sent_at", T.TimestampType()),
])
SOURCE_RUN = T.StructType([
    T.StructField("run_id", _S), T.StructField("source_name", _S), T.StructField("status", _S), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()),
    T.StructField("fetched_count", T.IntegerType()), T.StructField("accepted_count", T.IntegerType()), T.StructField("rejected_count", T.IntegerType()), T.StructField("error_message", _S), T.StructField("cost_units", T.DecimalType(12, 4)), T.StructField("metrics", _S),
])
