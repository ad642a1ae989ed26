"""Best representative of each duplicate group (problem 6).

Field by field, the usable values of a group are aligned token by token (progressively, the heaviest first), every column votes with the weights of its
values, and the existing value closest to the consensus survives. A vote counts a power of a large number for each respect (trust, time, length) in which its value is the best, so a value
that is best in all outvotes all others together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.instants import clean_space
from jobweave.llm.common import spread
from jobweave.session import write_shared

#: Distinct values aligned in one piece; a group with more is aligned in several, whose consensuses are aligned again.
BLOCK = 48
FIELDS = ["canonical_url", "direct_apply_url", "score", "description"]
_TOKEN = re.compile(r"\w+|[^\w\s]|\s+")

#: Texts that stand for a missing description, in lower case without the final stop.
STAND_INS = {
    "n/a", "na", "none", "null", "-", "tbd", "no description", "no description given", "no description available", "not available", "see website", "see posting", "see description", "duplicate copy",
    "apply on company site", "apply on company website", "description not available", "lorem ipsum", "test",
}


def usable_url(value: Column) -> Column:
    """Whether it is a web address of a posting: http(s), a host, and a path of two or more parts whose last part has a digit (a board has none)."""
    path = F.regexp_extract(value, r"^https?://[^/?#\s]+\.[^/?#\s]+/([^?#\s]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    whole = value.rlike(r"(?i)^\s*https?://[^/?#\s.]+\.[^\s]+$")
    numbered = F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1).rlike("[0-9]")
    by_query = value.rlike(r"[?&](?:id|job|jobid|job_id|gh_jid|req|reqid|requisition)=[^&\s]*[0-9]")
    return F.coalesce(whole & ((numbered & (F.size(parts) >= 2)) | by_query), F.lit(False))


def usable_description(value: Column) -> Column:
    """Whether it is neither cut (an ellipsis, ``[more]``, no end of a sentence) nor a stand-in (a set phrase, or no words but mark-up)."""
    bare = clean_space(F.regexp_replace(value, r"<[^<>]*>|&nbsp;", " "))
    cut = bare.rlike(r"(?i)(?:\.\.\.|…|[\[(](?:read )?(?:more|…|\.\.\.)[\])]|read more|show more)\W*$")
    ended = bare.rlike(r"""[.!?。][\s"'»”’)\]]*$""")
    return F.coalesce(~cut & ended & (F.length(bare) > 0) & ~F.lower(F.regexp_replace(bare, r"[.!\s]+$", "")).isin(*sorted(STAND_INS)), F.lit(False))


def long_values(copies: DataFrame, profiles: DataFrame) -> DataFrame:
    """group_id, field_name, value, usable, copy_id, trust_rank, scraped_at, size: one row per copy and field."""
    trust = profiles.select("source_name", "trust_rank").groupBy("source_name").agg(F.min("trust_rank").alias("trust_rank"))
    wide = copies.select("group_id", "copy_id", "source_name", "scraped_at", *[F.col(c).cast("string") for c in FIELDS]).where("group_id is not null").join(trust, "source_name", "left")
    ok = {"canonical_url": usable_url(F.col("canonical_url")), "direct_apply_url": usable_url(F.col("direct_apply_url")), "score": F.coalesce(F.col("score").try_cast("double") >= 0, F.lit(False)), "description": usable_description(F.col("description"))}
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value"), ok[c].alias("usable"), (F.length(c) if c == "description" else F.lit(0)).alias("size")) for c in FIELDS])).alias("f")
    low = F.to_timestamp(F.lit("1900-01-01"))
    return wide.select("group_id", "copy_id", F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("trust_rank"), F.coalesce("scraped_at", low).alias("scraped_at"), one).select("group_id", "f.*", "copy_id", "trust_rank", "scraped_at")


def _opcodes(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (of a, of b) that correspond; common beginnings and ends are taken off first, so that copies cut or marked up at an end cost no comparison."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    yield 0, low, 0, low
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    if not x or not y:
        yield low, low + len(x), low, low + len(y)
    else:
        for _, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            yield low + i, low + j, low + k, low + m
    yield len(a) - end, len(a), len(b) - end, len(b)


def align(values: list[tuple[str, float]]) -> tuple[list[str], float]:
    """The consensus tokens of weighted values and their total weight. Columns are kept in a profile that grows by one alignment per value.

    A value with more than half of all weight has the majority in every column however the others are aligned, so it is the consensus without aligning them.
    """
    ordered = sorted(values, key=lambda v: (-v[1], v[0]))
    whole = sum(w for _, w in ordered)
    if ordered[0][1] > whole / 2:
        return _TOKEN.findall(ordered[0][0]), whole
    columns: list[Counter] = [Counter({t: ordered[0][1]}) for t in _TOKEN.findall(ordered[0][0])]
    total = ordered[0][1]
    for text, weight in ordered[1:]:
        tokens = _TOKEN.findall(text)
        spine = [c.most_common(1)[0][0] if len(c) == 1 else max(c, key=lambda t: (c[t], t)) for c in columns]
        grown: list[Counter] = []
        for a, b, x, y in _opcodes(spine, tokens):
            width = max(b - a, y - x)
            for k in range(width):
                col = columns[a + k] if a + k < b else Counter({"": total})
                col[tokens[x + k] if x + k < y else ""] += weight
                grown.append(col)
        columns = grown
        total += weight
    out = [max(c, key=lambda t: (c[t], t)) for c in columns]
    return [t for t in out if t], total


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [align([(v["value"], float(v["weight"])) for v in vs]) for vs in b["vs"]]
        yield pd.DataFrame({"group_id": b["group_id"], "field_name": b["field_name"], "value": ["".join(g[0]) for g in got], "weight": [g[1] for g in got]})


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        far = []
        for value, goal in zip(b["value"], b["consensus"]):
            x, y = _TOKEN.findall(value), _TOKEN.findall(goal)
            far.append(0.0 if x == y else 1.0 - SequenceMatcher(None, x, y, autojunk=False).ratio())
        yield b.drop(columns="consensus").assign(distance=far)


def consensus_values(copies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every distinct usable value of a group and field with its distance to the consensus (null where another value is the consensus itself): group_id, field_name, value, copy_id (the smallest that holds
    it), trust_rank (best), scraped_at (latest), size, weight, distance, and whether the copies of the group differ in the field.

    A vote weighs the more the better the source's rank, by one more for each copy, the later the copy and, for a description, the longer; each respect in which no usable value of the group is better
    multiplies it by more than all plain weights together. Groups are collapsed to distinct values by partial aggregation first, and aligned in blocks of bounded size, so that no group must fit a task.
    Null groups give nothing; null scraped_at counts as oldest, an unknown source as least trusted. Repeated rows add weight and change nothing else. Empty tables give an empty result.
    """
    long = long_values(copies, profiles)
    keys = ["group_id", "field_name"]
    differ = long.groupBy(*keys).agg(((F.min("value") != F.max("value")) | (F.count_if(F.col("value").isNull()).between(1, F.count("*") - 1))).alias("differ"))
    weight = F.count("*") * (1 + 100 / (F.min("trust_rank") + 1.0))
    values = long.where("usable").groupBy(*keys, "value").agg(F.min("copy_id").alias("copy_id"), F.min("trust_rank").alias("trust_rank"), F.max("scraped_at").alias("scraped_at"), F.max("size").alias("size"), weight.alias("w"))
    values = write_shared(values, "usable-values")
    newest = F.max("scraped_at").alias("newest")
    tops = values.groupBy(*keys).agg(F.min("trust_rank").alias("best_rank"), newest, F.max("size").alias("longest"), F.count("*").alias("n"), F.max("w").alias("most"))
    values = values.join(differ, keys).join(tops, keys)
    age = (F.unix_timestamp("newest") - F.unix_timestamp("scraped_at")) / 86_400.0
    plain = F.col("w") / F.col("most") * (1 + 1 / (1 + age)) * (1 + F.log1p("size") / F.log1p(F.greatest("longest", F.lit(1))))
    best = (F.col("trust_rank") == F.col("best_rank")).cast("int") + (F.col("scraped_at") == F.col("newest")).cast("int") + (F.col("size") == F.col("longest")).cast("int")
    # plain weights lie between w / most and 4, so this is more than all of them against the least
    values = values.withColumn("weight", plain * F.pow(F.col("n") * 4 * F.col("most") + 1, best)).drop("w", "most", "n", "newest", "best_rank", "longest")
    values = write_shared(values, "group-values")
    work = values.select(*keys, "value", "weight")
    most = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while True:
        cut = -(-most // BLOCK)
        block = F.pmod(F.xxhash64("value"), F.lit(max(cut, 1))).alias("block")
        lists = work.groupBy(*keys, block).agg(F.collect_list(F.struct("value", "weight")).alias("vs"))
        work = spread(lists).mapInPandas(_blocks, "group_id long, field_name string, value string, weight double")
        if cut <= 1:
            break
        work, most = write_shared(work, "block-consensus"), cut
    agreed = write_shared(work.select(*keys, F.col("value").alias("consensus")), "consensus")
    held = agreed.join(values.select(*keys, F.col("value").alias("consensus"), F.lit(True).alias("held")), [*keys, "consensus"], "left")
    joined = values.join(held, keys)
    is_held = F.coalesce("held", F.lit(False))
    near = joined.where(is_held).withColumn("distance", F.when(F.col("value") == F.col("consensus"), 0.0)).drop("held", "consensus")
    far = spread(joined.where(~is_held).drop("held")).mapInPandas(_distances, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema) + ", distance double")
    return near.unionByName(far)


def survivors(copies: DataFrame, profiles: DataFrame) -> DataFrame:
    """group_id, field_name, value, copy_id, distance: the surviving value of each group and field that has a usable one, with its rank, time and length and the best of each in the group."""
    v = consensus_values(copies, profiles)
    best = F.min_by(F.struct("value", "copy_id", "distance", "trust_rank", "scraped_at", "size", "differ"), F.struct(F.coalesce("distance", F.lit(2.0)), "trust_rank", "copy_id")).alias("b")
    top = [F.min("trust_rank").alias("best_rank"), F.max("scraped_at").alias("newest"), F.max("size").alias("longest")]
    return v.groupBy("group_id", "field_name").agg(best, *top).select("group_id", "field_name", "b.*", "best_rank", "newest", "longest")


def undisputed(copies: DataFrame, profiles: DataFrame) -> DataFrame:
    """group_id, field_name, copy_id of the survivors of groups whose copies differ in the field, if an exact check confirms that no other usable value is more trusted, later or longer.

    Among values equal in all three respects the one closest to the consensus survives.
    """
    v = survivors(copies, profiles).where("differ and trust_rank = best_rank and scraped_at = newest and size = longest")
    return v.select("group_id", "field_name", "copy_id")
