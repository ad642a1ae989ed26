"""Landed files as payloads and documents: what was fetched lies in a folder, a manifest says which source each file is of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.schema import RAW_POSTING, REQUIRED


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Raw postings of a JSON array with the record's own field names (camel case); rows without a required field are dropped."""
    camel = {c: "".join(w.capitalize() if k else w for k, w in enumerate(c.split("_"))) for c in RAW_POSTING.fieldNames()}
    rows = spark.read.schema(", ".join(f"`{v}` string" for v in camel.values())).json(path, multiLine=True)
    out = rows.select(*[F.col(v).alias(k) for k, v in camel.items()])
    return out.where(" and ".join(f"{c} is not null" for c in REQUIRED))


def landed(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` (file, ...) with ``payload``: the text of each file, '' where it did not arrive, so that its source fails and no other does.

    A file is one row; payloads are bounded by what one fetch returns.
    """
    files = spark.read.text(folder, wholetext=True).select(F.substring_index(F.col("_metadata.file_name"), "/", -1).alias("file"), F.col("value").alias("payload"))
    return manifest.join(files, "file", "left").withColumn("payload", F.coalesce("payload", F.lit("")))


def cap_per_source(rows: DataFrame, ordinal: str, limit: int) -> DataFrame:
    """The first rows of each source; the rank filter lets Spark cut before it shuffles."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("source_name").orderBy(ordinal)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
