"""Mixing sources to target weights (problem 9): Pareto order sampling.

Every document of a source gets the whole copies that its share makes certain; the rest is drawn in the order of (random odds) / (inclusion odds) until the
source's tokens are reached. The place where a source's order is cut is found from a histogram, so no task ever holds or sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from jobweave.llm.common import bounded
from jobweave.llm.tokens import TOKENIZER, count_tokens
from jobweave.session import write_shared

#: Cells of the histogram of ranks per mix and source; within the last cell the order is exact.
CELLS = 16_384
#: Targets are few.
MAX_TARGETS = 20_000


def draw_mixes(docs: DataFrame, targets: DataFrame, seed: int = 42, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """mix_name, source, doc_id, n_tokens, n_copies of every document drawn at least once.

    ``docs`` has doc_id, source, text; ``targets`` mix_name, source, target_share (a relative weight), max_repeats. Shares count among the sources of the mix that
    have tokens; a source without any is left to the report. A mix is as large as its scarcest source allows (or ``total_tokens``, if smaller), so no document is
    drawn more than max_repeats times. Documents that hold the same text share one chance: their inclusion odds are divided by their number. Targets with a null,
    zero or negative share or repeats below 1 draw nothing. Documents without tokens are never drawn. doc_id is taken as the identity: rows repeated under one id count once, the first by source and size if they differ. The draw
    depends on ``seed`` only, not on partitions. Empty tables give an empty result; only the named columns are read.
    """
    counted = count_tokens(docs.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same")), tokenizer=tokenizer)
    counted = counted.where("n_tokens > 0 and source is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens", "same")).alias("r")).select("doc_id", "r.*")
    counted = write_shared(counted, "token-counts")
    wanted = targets.where("target_share > 0 and max_repeats >= 1").select("mix_name", "source", "target_share", "max_repeats").dropDuplicates(["mix_name", "source"])
    twins = counted.groupBy("same").agg(F.count("*").alias("twins"))
    weighted = write_shared(counted.join(twins, "same").select("doc_id", "source", "n_tokens", (1 / F.col("twins")).alias("weight")), "weighted")
    stock = weighted.groupBy("source").agg(F.sum("n_tokens").alias("stock"), F.sum(F.col("weight") * F.col("n_tokens")).alias("stock_weight"))
    plan = bounded(wanted.join(stock, "source").select("mix_name", "source", "target_share", "max_repeats", "stock", "stock_weight"), MAX_TARGETS, "the list of targets")
    rows = []
    for mix in sorted({r["mix_name"] for r in plan}):
        own = [r for r in plan if r["mix_name"] == mix]
        shares = sum(r["target_share"] for r in own)
        size = min(r["max_repeats"] * r["stock"] * shares / r["target_share"] for r in own)
        size = min(size, total_tokens) if total_tokens is not None else size
        for r in own:
            want = size * r["target_share"] / shares
            whole = min(int(want / r["stock"] + 1e-9), r["max_repeats"])
            rest = max(0.0, want - whole * r["stock"]) if whole < r["max_repeats"] else 0.0
            rows.append((mix, r["source"], whole, float(rest), float(rest / r["stock_weight"])))
    spark = docs.sparkSession
    cuts = spark.createDataFrame(rows, "mix_name string, source string, whole int, rest double, factor double")
    # at most MAX_TARGETS rows, so this side may go to every task
    each = weighted.join(F.broadcast(cuts), "source")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    chance = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("factor") * F.col("weight")))
    odds = (uniform / (1 - uniform)) / (chance / (1 - chance))
    ranked = each.withColumn("rank", odds / (1 + odds)).withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(F.col("rank") * CELLS)).cast("int"))
    keys = ["mix_name", "source"]
    cells = ranked.where("rest > 0").groupBy(*keys, "cell").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    order = W.Window.partitionBy(*keys).orderBy("cell").rowsBetween(W.Window.unboundedPreceding, 0)
    filled = cells.withColumn("after", F.sum("tokens").over(order))
    last = filled.where("after >= rest").groupBy(*keys).agg(F.min("cell").alias("last"), F.min(F.col("after") - F.col("tokens")).alias("before"))
    bound = ranked.join(F.broadcast(last), keys, "left")
    inside = bound.where("rest > 0 and cell = last")
    step = W.Window.partitionBy(*keys).orderBy("rank", "doc_id").rowsBetween(W.Window.unboundedPreceding, 0)
    # the document that crosses the target is taken if more than half of it is still wanted
    inside = inside.withColumn("sum", F.sum("n_tokens").over(step)).where(F.col("before") + F.col("sum") - F.col("n_tokens") / 2 <= F.col("rest"))
    extra = bound.where("rest > 0 and (cell < last or last is null)").select(*keys, "doc_id", "n_tokens", F.lit(1).alias("n")).unionByName(inside.select(*keys, "doc_id", "n_tokens", F.lit(1).alias("n")))
    certain = each.where("whole > 0").select(*keys, "doc_id", "n_tokens", F.col("whole").alias("n"))
    return certain.unionByName(extra).groupBy(*keys, "doc_id", "n_tokens").agg(F.sum("n").cast("int").alias("n_copies")).select("mix_name", "source", "doc_id", "n_tokens", "n_copies")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share (of the mix's weights), actual_share of all tokens, n_tokens, n_documents, most_copies for every target, drawn or not."""
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("n_copies").alias("most_copies"))
    all_ = got.groupBy("mix_name").agg(F.sum("n_tokens").alias("mix_tokens"))
    weights = targets.groupBy("mix_name").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("weights"))
    out = targets.join(weights, "mix_name").join(got, ["mix_name", "source"], "left").join(all_, "mix_name", "left")
    none = F.lit(0).cast("long")
    return out.select("mix_name", "source", F.round(F.col("target_share") / F.col("weights"), 6).alias("target_share"), F.round(F.coalesce("n_tokens", none) / F.col("mix_tokens"), 6).alias("actual_share"), F.coalesce("n_tokens", none).alias("n_tokens"), F.coalesce("n_documents", none).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
