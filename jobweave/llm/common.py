"""Shared pieces of the operators: spreading Python work, bounded lists, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.session import discard, write_shared


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition before Python work: adaptive execution sizes partitions by bytes, which packs short but costly values into one task."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a list that must stay small, or an error that says so: it reads at most ``most + 1`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) for the undirected edges ``a``, ``b``.

    Alternating large-star and small-star: every node's neighbours are hung on the smallest one, until nothing changes. A node with a third of all
    edges is only ever the centre of a star, which is aggregated by ``min`` on the map side. Each round is written to the shared folder. Self-edges
    and repeated edges are allowed; an empty input gives an empty result.
    """
    e = write_shared(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        up = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        least = up.groupBy("x").agg(F.min("y").alias("m"))
        small = up.join(least, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("a <> b").distinct()
        new = write_shared(small, "edges")
        change = new.join(e, ["a", "b"], "left_anti").limit(1).count() + e.join(new, ["a", "b"], "left_anti").limit(1).count()
        discard(e)
        e = new
        if not change:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
