"""Configuration files as rules and dimension tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.rules import Rule
from jobweave.functions.text import normalize_text


def load_rules(path: str) -> list[Rule]:
    """Ordered rules of a JSON list of objects (value, pattern, and optionally field and unless)."""
    with open(path, encoding="utf-8") as f:
        return [Rule(**r) for r in json.load(f)]


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, canonical of a JSON object of canonical names with lists of aliases; a canonical name is an alias of itself."""
    with open(path, encoding="utf-8") as f:
        pairs = [(a, canonical) for canonical, aliases in json.load(f).items() for a in [canonical, *aliases]]
    return spark.createDataFrame(pairs, "alias string, canonical string").select(normalize_text(F.col("alias")).alias("alias"), "canonical").where("alias <> ''").distinct()
