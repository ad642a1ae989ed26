"""Filling fixed-capacity containers with items (problem 8): cost-balanced packing.

The cost of an item is linear plus quadratic in its tokens (attention within it). Items are taken in descending order and go to the window of the lowest cost
that still has room. Items are dealt at random to shards of a bounded number of windows, which are packed independently in all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import bounded, spread
from jobweave.llm.tokens import TOKENIZER, count_tokens
from jobweave.session import write_shared

#: Windows that a shard should fill. A shard leaves about one window partly filled, so the loss is about 1/SHARD_WINDOWS.
SHARD_WINDOWS = 400
#: Cost per token, and per squared token, of an item.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Capacities are few.
MAX_SIZES = 1_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item (none larger than the capacity); items descending, each to the cheapest window with room, a new one if there is none."""
    order = np.argsort(-sizes, kind="stable")
    room = np.full(max(1, -(-int(sizes.sum()) // capacity)), capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    out = np.empty(len(sizes), dtype=np.int64)
    for k in order:
        s = sizes[k]
        fits = room >= s
        if fits.any():
            w = int(np.argmin(np.where(fits, cost, np.inf)))
        else:
            w = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[w] -= s
        cost[w] += LINEAR * s + QUADRATIC * s * s
        out[k] = w
    return out


SCHEMA = "pack_name string, window_id string, doc_id long, piece_no int, first_token long, n_tokens long"


def _packer(name: str, capacity: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        windows = [f"{shard}-{w}" for w in pack(pdf["n_tokens"].to_numpy(), capacity)]
        return pdf.assign(pack_name=name, window_id=windows)[["pack_name", "window_id", "doc_id", "piece_no", "first_token", "n_tokens"]]

    return one


def pack_documents(docs: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_name, window_id, doc_id, piece_no, first_token, n_tokens: the windows of each capacity and what is in them.

    ``docs`` has doc_id and text, ``sizes`` pack_name and capacity_tokens. A text larger than the capacity is cut into full pieces, each a window of its own,
    and a rest that is packed like any other item; no other text is cut. Texts of no tokens take no room and are in no window. Capacities that are null or not
    positive are left out. Repeated rows are items of their own. Empty tables give an empty result; only the named columns are read.
    """
    capacities = bounded(sizes.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct(), MAX_SIZES, "the list of pack sizes")
    counted = write_shared(count_tokens(docs.select("doc_id", "text"), tokenizer=tokenizer), "token-counts")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    result = docs.sparkSession.createDataFrame([], SCHEMA)
    for name, capacity in capacities:
        shards = max(1, round(total / (capacity * SHARD_WINDOWS)))
        count = F.ceil(F.col("n_tokens") / capacity).cast("int")
        piece = F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no")
        cut = counted.where("n_tokens > 0").select("doc_id", "n_tokens", piece).select("doc_id", "piece_no", (F.col("piece_no") * F.lit(capacity)).cast("long").alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no") * F.lit(capacity)).alias("n_tokens"))
        full = cut.where(F.col("n_tokens") == capacity).select(F.lit(name).alias("pack_name"), F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string"), F.monotonically_increasing_id().cast("string")).alias("window_id"), "doc_id", "piece_no", "first_token", "n_tokens")

        rest = spread(cut.where(F.col("n_tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int")), "shard")
        result = result.unionByName(full).unionByName(rest.groupBy("shard").applyInPandas(_packer(name, capacity), SCHEMA))
    return result


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """pack_name, capacity_tokens, n_windows, n_items, fill (share of the windows' room that is used), largest and smallest cost of a window."""
    cost = F.sum(LINEAR * F.col("n_tokens") + QUADRATIC * F.col("n_tokens") * F.col("n_tokens"))
    windows = packed.groupBy("pack_name", "window_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), cost.alias("cost"))
    each = windows.groupBy("pack_name").agg(F.count("*").alias("n_windows"), F.sum("items").alias("n_items"), F.sum("used").alias("used"), F.round(F.max("cost"), 1).alias("max_cost"), F.round(F.min("cost"), 1).alias("min_cost"))
    return each.join(sizes.select("pack_name", "capacity_tokens"), "pack_name").select("pack_name", "capacity_tokens", "n_windows", "n_items", F.round(F.col("used") / (F.col("n_windows") * F.col("capacity_tokens")), 4).alias("fill"), "max_cost", "min_cost")
