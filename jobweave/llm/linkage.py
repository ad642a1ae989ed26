"""Matching entities across sources without keys (problem 7): soft-logic linkage.

A row of either table may mean one of the postings of its role that are known by cycle and place (its concepts). The variable of a row and a concept, in [0, 1], says how far it does.
Weighted rules are ground into squared and linear hinges: a row means what it resembles (graded by role, cycle and place) and not what it does not; it means one concept
(exclusivity); rows of one link mean the same (transitivity through the link); two rows that mean one concept match (transitivity through the concept, the Lukasiewicz conjunction).
The convex problem is solved by the alternating direction method of multipliers: every ground rule owns a copy of its variables, the copies are averaged,
multipliers pull them together. It falls apart by rows and links, so the blocks are solved in all tasks at once, each until it has converged; the values are the confidences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import spread
from jobweave.llm.history import role_keys, same_role
from jobweave.llm.postings import entities, link_key, read_postings, read_standard
from jobweave.llm.strings import edits
from jobweave.session import write_shared

#: How far a row resembles a concept: all parts agree, one unknown, both unknown; the factor of a misspelt role; the confidence of a pair with the same link and the same employer or role.
FULL, ONE_OPEN, BOTH_OPEN, SLIP, SAME_LINK = 1.0, 0.85, 0.75, 0.9, 0.97
#: Part of the resemblance that an open part owes to how many of the role's rows have the concept.
TILT = 0.5
#: Weights of the rules: resemblance of a whole row and of an open one (squared), one concept for a row, the same for rows of one link (linear).
W_WHOLE, W_OPEN, W_EXCLUSIVE, W_SAME = 4.0, 1.0, 10.0, 1.0
#: Confidence from which a pair is accepted: more than half, so that of two equal concepts neither is.
ACCEPT = 0.55
#: Variables solved at once in a task; a block is never divided.
BATCH_ROWS = 50_000
MOST_ROUNDS = 20_000


def solve(similar: np.ndarray, weight: np.ndarray, row: np.ndarray, concept: np.ndarray, block: np.ndarray, rho: float = 2.0, tolerance: float = 1e-5) -> np.ndarray:
    """Values of the variables: ``row`` and ``concept`` number what they are about, ``block`` the rows of one link.

    Minimises the sum of weight*(y - similar)^2, W_EXCLUSIVE*max(0, sum of y of a row - 1) and W_SAME*|y - z| over y in [0, 1], where z is the common value of the variables of one block and
    concept. A block stops when neither its values nor the gaps between copies move by more than ``tolerance``, whatever other blocks do.
    """
    n = len(similar)
    out = np.clip(similar.astype(float), 0, 1)
    if n == 0:
        return out
    _, part = np.unique(block, return_inverse=True)
    # a block whose rows have one concept each, all the same, has nothing to settle but its common value
    todo = np.flatnonzero(np.bincount(part)[part] > 1)
    if not len(todo):
        return out
    similar, weight = similar[todo].astype(float), weight[todo].astype(float)
    pairs = lambda a, b: np.unique(np.stack([a[todo], b[todo]]), axis=1, return_inverse=True)[1].ravel()
    one, same, part = pairs(block, row), pairs(block, concept), np.unique(part[todo], return_inverse=True)[1]
    live = todo
    y = np.clip(similar, 0, 1)
    z = np.bincount(same, y) / np.bincount(same)
    ua, uc, ud, ue = (np.zeros(len(y)) for _ in range(4))
    for _ in range(MOST_ROUNDS):
        size, many = np.bincount(one), np.bincount(same)
        twin = many[same] > 1
        a = (2 * weight * similar + rho * (y - ua)) / (2 * weight + rho)
        v = y - uc
        step = np.minimum(np.maximum(np.bincount(one, v) - 1, 0) / size, W_EXCLUSIVE / rho)
        c = v - step[one]
        v, w = y - ud, z[same] - ue
        move = np.clip((v - w) / 2, -W_SAME / rho, W_SAME / rho)
        d, e = v - move, w + move
        new = np.clip(np.where(twin, (a + ua + c + uc + d + ud) / 3, (a + ua + c + uc) / 2), 0, 1)
        z = np.clip(np.bincount(same, e + ue) / many, 0, 1)
        ua, uc, ud, ue = ua + a - new, uc + c - new, np.where(twin, ud + d - new, 0), np.where(twin, ue + e - z[same], 0)
        gap = np.maximum.reduce([np.abs(new - y), np.abs(a - new), np.abs(c - new), np.where(twin, np.abs(d - new), 0), np.where(twin, np.abs(e - z[same]), 0)])
        y = new
        worst = np.zeros(part.max() + 1)
        np.maximum.at(worst, part, gap)
        done = (worst < tolerance)[part]
        if done.any():
            out[live[done]] = y[done]
            keep = ~done
            if not keep.any():
                return out
            groups = np.unique(same[keep])
            live, y, similar, weight, ua, uc, ud, ue = (x[keep] for x in (live, y, similar, weight, ua, uc, ud, ue))
            z = z[groups]
            one, same, part = (np.unique(x[keep], return_inverse=True)[1] for x in (one, same, part))
    out[live] = y
    return out


def _grid(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with a variable of likeness 0 for every row of a block and concept of the block that it does not resemble: rows of one link count against what they do not mean, too."""
    many = frame.groupby("block")["d"].transform("nunique") > 1
    if not many.any():
        return frame
    part = frame[many]
    whole = part[["block", "d", "side", "whole"]].drop_duplicates().merge(part[["block", "concept"]].drop_duplicates(), on="block")
    whole = whole.merge(part[["block", "d", "side", "concept", "similar"]], how="left", on=["block", "d", "side", "concept"]).fillna({"similar": 0.0})
    return pd.concat([frame[~many], whole[frame.columns]], ignore_index=True)


def _solve_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block; whole blocks are gathered up to the batch size."""
    held: list[pd.DataFrame] = []
    n = 0

    def flush(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _grid(frame)
        row = frame["d"].to_numpy() * 2 + (frame["side"].to_numpy() == "l")
        found = solve(frame["similar"].to_numpy(), np.where(frame["whole"].to_numpy(), W_WHOLE, W_OPEN), row, frame["concept"].to_numpy(), frame["block"].to_numpy())
        out = frame[["side", "d", "concept"]].assign(value=found)
        return out[out["value"] >= ACCEPT]

    for b in batches:
        held.append(b)
        n += len(b)
        if n >= BATCH_ROWS:
            frame = pd.concat(held, ignore_index=True)
            last = frame["block"].iloc[-1]
            ready, rest = frame[frame["block"] != last], frame[frame["block"] == last]
            if len(ready):
                yield flush(ready)
            held, n = [rest], len(rest)
    if n:
        yield flush(pd.concat(held, ignore_index=True))


def _near_roles(asked: DataFrame, right: DataFrame, standard: set[str]) -> DataFrame:
    """entity, signature, asked, role: the roles of the right side that are asked for, or differ from one that is by a misspelt word (the one with the fewest slips), with their likeness."""

    @F.pandas_udf("array<string>")
    def keys(signatures: pd.Series) -> pd.Series:
        return signatures.map(role_keys)

    @F.pandas_udf("int")
    def slips(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(edits(p, q, 2) for p, q in zip(sorted(set(x.split()) - set(y.split())), sorted(set(y.split()) - set(x.split())))) if same_role(x, y, standard) else 9 for x, y in zip(a, b)], dtype="int32")

    others = right.join(asked.select("entity").distinct(), "entity", "left_semi").join(asked, ["entity", "signature"], "left_anti")
    a = asked.select("entity", F.col("signature").alias("asked"), F.explode(keys("signature")).alias("key"))
    b = others.select("entity", "signature", F.explode(keys("signature")).alias("key"))
    close = a.join(b, ["entity", "key"]).select("entity", "signature", "asked").distinct().withColumn("slips", slips("asked", "signature")).where("slips < 9")
    best = close.groupBy("entity", "signature").agg(F.min_by("asked", F.struct("slips", "asked")).alias("asked"))
    return asked.select("entity", "signature", F.col("signature").alias("asked"), F.lit(FULL).alias("role")).unionByName(best.withColumn("role", F.lit(SLIP)))


def match_records(left: DataFrame, right: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """left_id, right_id, confidence of the records of both tables that mean the same posting.

    Both tables have id, name (of the employer), title, team, place, hint (cycle) and link; any may be null, and a record without an id is none. Records without an employer or a
    readable title match only by link. Repeated rows match alike; each pair of ids comes once. A null part agrees with every value known for the same employer, role and team, and the rules decide among
    them; if none is known, rows that lack the same part agree. Empty tables give an empty result.

    Records are collapsed to descriptors first, so copies cost one comparison. Candidates are blocked by employer and role, misspelt roles by pairs of words; a descriptor has as many variables as its role has
    fitting concepts (cycles times places at most), so no pairs of rows are compared, and accepted pairs are joined on the concept. Nothing is broadcast but the reference list and the standard
    spellings, both with checked bounds.
    """
    standard = read_standard(right.select("title").unionByName(left.select("title")))
    linked = write_shared(entities(left.select("name").unionByName(right.select("name")), aliases), "linked-names")
    sides = {}
    for side, rows in (("l", left), ("r", right)):
        base = rows.where("id is not null").select("id", "name", "title", "team", "place", "hint", link_key(F.col("link")).alias("link"))
        read = read_postings(base, standard, reference).join(linked, "name", "left")
        ident = F.xxhash64(F.coalesce("entity", F.lit("")), "signature", "cycle", F.to_json(F.array_sort("places")), F.coalesce("link", F.lit("")))
        sides[side] = write_shared(read.select("id", F.coalesce("entity", F.lit("")).alias("entity"), "signature", "cycle", F.array_sort("places").alias("places"), "link", ident.alias("d")), "records")
    asked = write_shared(sides["l"].where("entity <> '' and signature <> ''").select("entity", "signature").distinct(), "asked")
    roles = write_shared(_near_roles(asked, sides["r"].where("entity <> '' and signature <> ''").select("entity", "signature").distinct(), set(standard)), "near-roles")
    # only roles that the left side asks for matter to the right side, in every step but the one on the link
    both = None
    for side in "lr":
        part = sides[side].join(roles, ["entity", "signature"]).groupBy("entity", F.col("asked").alias("signature"), "role", "cycle", "places", "link", "d").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
        both = part if both is None else both.unionByName(part)
    both = write_shared(both.withColumn("ask", F.xxhash64("entity", "signature")).drop("entity", "signature"), "asked-records")
    block = F.when(F.col("link").isNotNull(), F.xxhash64("ask", "link")).otherwise(F.xxhash64("side", "d"))
    both = both.select("side", "d", "ask", "role", F.when(F.col("cycle") != "", F.col("cycle")).alias("cycle"), "places", "n", block.alias("block"))
    # the concepts of a role: its cycles and places as they occur together, with the number of rows; a place among several counts for little
    told = both.where("cycle is not null and size(places) > 0").select("ask", "cycle", "n", "places", F.explode("places").alias("place"))
    concepts = told.groupBy("ask", F.col("cycle").alias("c"), F.col("place").alias("p")).agg(F.sum(F.when(F.size("places") == 1, F.col("n").cast("double")).otherwise(0.05)).alias("many"))
    concepts = write_shared(concepts, "concepts")
    concept = F.xxhash64("ask", "c", "p").alias("concept")
    is_whole = F.col("cycle").isNotNull() & (F.size("places") == 1)
    whole = both.where(is_whole).select("side", "d", "block", F.lit(True).alias("whole"), F.xxhash64("ask", "cycle", F.col("places")[0]).alias("concept"), (F.col("role") * FULL).alias("similar"))
    rest = both.where(~is_whole)
    fits = (F.col("cycle").isNull() | (F.col("cycle") == F.col("c"))) & ((F.size("places") == 0) | F.array_contains("places", F.col("p")))
    met = rest.join(concepts, "ask").where(fits)
    all_of = met.groupBy("side", "d", "ask").agg(F.sum("many").alias("total"))
    graded = F.col("role") * F.when(F.col("cycle").isNull() & (F.size("places") != 1), BOTH_OPEN).otherwise(ONE_OPEN)
    open_ = met.join(all_of, ["side", "d", "ask"]).select("side", "d", "block", F.lit(False).alias("whole"), concept, (graded * (1 - TILT * (1 - F.col("many") / F.col("total")))).alias("similar"))
    # rows of which nothing known fits: what they lack is a concept of its own
    alone = rest.join(all_of, ["side", "d", "ask"], "left_anti").where("size(places) <= 1").select("side", "d", "block", F.lit(False).alias("whole"), F.xxhash64("ask", F.coalesce("cycle", F.lit("?")), F.coalesce(F.get("places", F.lit(0)).cast("string"), F.lit("?"))).alias("concept"), graded.alias("similar"))
    ground = whole.unionByName(open_).unionByName(alone).groupBy("side", "d", "block", "concept").agg(F.max("whole").alias("whole"), F.max("similar").alias("similar"))
    solved = spread(ground, "block").sortWithinPartitions("block").mapInPandas(_solve_blocks, "side string, d long, concept long, value double")
    solved = write_shared(solved, "solved")
    a = solved.where("side = 'l'").select("concept", F.col("d").alias("ld"), F.col("value").alias("lv"))
    b = solved.where("side = 'r'").select("concept", F.col("d").alias("rd"), F.col("value").alias("rv"))
    meet = a.join(b, "concept").select("ld", "rd", (F.col("lv") + F.col("rv") - 1).alias("confidence")).where(F.col("confidence") >= ACCEPT)
    # the same link, if employer or role agree too
    linked_left = sides["l"].where("link is not null").select("link", F.col("d").alias("ld"), F.col("entity").alias("le"), F.col("signature").alias("lg")).distinct()
    linked_right = sides["r"].where("link is not null").select("link", F.col("d").alias("rd"), F.col("entity").alias("re"), F.col("signature").alias("rg")).distinct()
    by_url = linked_left.join(linked_right, "link").where("(le = re and le <> '') or (lg = rg and lg <> '')").select("ld", "rd", F.lit(SAME_LINK).alias("confidence"))
    found = meet.unionByName(by_url).groupBy("ld", "rd").agg(F.max("confidence").alias("confidence"))
    ids = lambda k, d, name: sides[k].select(F.col("id").alias(name), F.col("d").alias(d))
    return found.join(ids("l", "ld", "left_id"), "ld").join(ids("r", "rd", "right_id"), "rd").groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence"))
