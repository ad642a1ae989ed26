"""Mixed timestamp formats and zones: a dictionary of distinct written values, parsed once each.

``InstantDictionary`` keeps (value, zone, date_order) -> (instant_us, age_us) as immutable parquet parts. An update deduplicates the
incoming values, anti-joins them with what is stored, parses only the new ones, and appends one part. ``resolve`` joins the normalised
instants back to the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions.instants import age_us, clean_space, instant_us, looks_like_age
from jobweave.session import shared_dir

KEYS = ["value", "zone", "date_order"]
SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(k, T.LongType()) for k in ("instant_us", "age_us")])


class InstantDictionary:
    """The parsed values, stored under ``path`` (in the shared folder unless a lasting one is named).

    A null zone or order is stored as the empty text. Values that mean no instant are stored too, with nulls, so they are not tried again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/instants-{uuid.uuid4().hex}"
        self.fresh = path is None

    def read(self) -> DataFrame:
        if self.fresh:
            return self.spark.createDataFrame([], SCHEMA)
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def update(self, values: DataFrame) -> "InstantDictionary":
        """Add the values (columns ``value``, ``zone``, ``date_order``) that are not stored yet; a part is written even if it is empty."""
        distinct = values.select(*KEYS).where("value is not null").distinct()
        if not self.fresh:
            distinct = distinct.join(self.read(), KEYS, "left_anti")
        clean = clean_space(F.col("value"))
        parsed = distinct.withColumn("clean", clean).select(*KEYS, instant_us(F.col("clean"), F.col("zone"), F.col("date_order")).alias("instant_us"), age_us(F.col("clean")).alias("age_us"))
        parsed.write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")
        self.fresh = False
        return self


def normalise_instants(rows: DataFrame, fields: list[str], anchor: str, zone: str, date_order: str, keep: list[str], dictionary: InstantDictionary | None = None) -> DataFrame:
    """One row per row of ``rows`` and field whose text denotes an instant: ``keep`` + field_name + instant_us.

    ``anchor`` is the field from which an age counts back. Null, blank and meaningless texts (``Rolling``, ``N/A``, impossible dates)
    give no row. Repeated rows give repeated results; nothing is dropped. Only the named columns are read and the operator's own begin with ``_``, so columns called
    ``zone`` or ``value`` do no harm; ``keep`` may hold any but ``field_name`` and ``instant_us``. An empty table gives an empty result. An age whose anchor cannot be read gives no row.

    The texts cross the network twice (to be made distinct and to be joined), never as whole rows; the joins are left to adaptive
    execution, which splits a text that a third of all rows share.
    """
    dictionary = dictionary or InstantDictionary(rows.sparkSession)
    base = rows.select(*[F.col(k) for k in keep], F.coalesce(F.col(zone), F.lit("")).alias("_zone"), F.coalesce(F.col(date_order), F.lit("")).alias("_date_order"), F.col(anchor).alias("_anchor"), *[F.col(f).alias(f"_f{k}") for k, f in enumerate(fields)])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{k}").alias("value")) for k, f in enumerate(fields)])).alias("_p")
    long = base.select(*keep, "_zone", "_date_order", "_anchor", pairs).select(*keep, "_zone", "_date_order", F.col("_p.field").alias("_field"), F.col("_p.value").alias("_value"), F.when(looks_like_age(F.col("_p.value")), F.col("_anchor")).alias("_anchor"))
    long = long.where(F.col("_value").rlike("[0-9]") | F.col("_anchor").isNotNull())
    to_keys = {"_value": "value", "_zone": "zone", "_date_order": "date_order"}
    texts = long.select("_value", "_zone", "_date_order").unionByName(base.where(~F.lit(anchor in fields)).select(F.col("_anchor").alias("_value"), "_zone", "_date_order"))
    dictionary.update(texts.withColumnsRenamed(to_keys))
    known = dictionary.read().withColumnsRenamed({v: k for k, v in to_keys.items()} | {"instant_us": "_instant", "age_us": "_age"})
    keys = list(to_keys)
    absolute = known.where("_instant is not null").select(*keys, "_instant")
    plain = long.where("_anchor is null").join(absolute, keys).select(*keep, "_field", "_instant")
    ages = long.where("_anchor is not null").join(known.where("_age is not null").select(*keys, "_age"), keys)
    back = absolute.withColumnsRenamed({"_value": "_anchor", "_instant": "_base"})
    aged = ages.join(back, ["_anchor", "_zone", "_date_order"]).select(*keep, "_field", (F.col("_base") - F.col("_age")).alias("_instant"))
    return plain.unionByName(aged).select(*keep, F.col("_field").alias("field_name"), F.col("_instant").alias("instant_us"))
