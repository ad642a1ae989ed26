import random

import pytest
from pyspark.sql import functions as F

from jobweave.operators import dedupe
from jobweave.operators.dedupe import Order, alternative_keys, cap_groups, collapse, distinct_first, fair_top, greedy_dedupe, members, merged_location


def sequential(rows):
    claimed, kept = set(), []
    for ident, rank, keys in sorted(rows, key=lambda r: (r[1], r[0])):
        if not claimed & set(keys or []):
            kept.append(ident)
            claimed |= set(keys or [])
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedupe_equals_the_sequential_scan(spark, seed, monkeypatch):
    monkeypatch.setattr(dedupe, "SCAN_KEYS", (0, 12, 40, 10_000)[seed])  # by rounds alone, by both, by the scan alone
    rnd = random.Random(seed)
    rows = [(k, rnd.randrange(6), [f"k{rnd.randrange(25)}" for _ in range(rnd.randrange(4))] or None) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, rank int, keys array<string>, _key string")
    assert sorted(r.id for r in greedy_dedupe(df.drop("_key"), "id", "keys", [F.col("rank")]).collect()) == sequential(rows)


def test_a_dropped_row_claims_nothing(spark):
    rows = [(1, 1, ["u", "a"]), (2, 2, ["u", "s"]), (3, 3, ["s"])]
    df = spark.createDataFrame(rows, "id int, rank int, keys array<string>")
    assert sorted(r.id for r in greedy_dedupe(df, "id", "keys", [F.col("rank")]).collect()) == [1, 3]
    assert greedy_dedupe(df.limit(0), "id", "keys", [F.col("rank")]).count() == 0


def test_keys_of_missing_parts(spark):
    df = spark.createDataFrame([(None, "c", " ", "t", "l", "y", "b", "", "1")], "u string, c string, i string, t string, l string, y string, b string, s string, k string")
    assert df.select(alternative_keys(*[F.col(c) for c in "uc"], F.col("i"), *[F.col(c) for c in "tlybsk"])).first()[0] == ["key:1", "tuple:c|t|l|y"]


def dealt(rows, limit):
    queues = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        queues.setdefault(r[1], []).append(r)
    order = sorted(queues, key=lambda c: (-queues[c][0][2], queues[c][0][0]))
    out, n = [], 0
    while len(out) < limit and any(len(q) > n for q in queues.values()):
        out += [queues[c][n] for c in order if len(queues[c]) > n]
        n += 1
    return [r[0] for r in out[:limit]]


@pytest.mark.parametrize("seed", range(3))
def test_fair_top_equals_the_deal(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "a", "a", "b", "c", None]) or "n", rnd.randrange(5)) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, company string, score int")
    order = [Order(F.col("score"), True), Order(F.col("id"))]
    for limit in (0, 1, 8, 100):
        got = fair_top(df, "company", order, limit).orderBy("deal_no")
        assert [r.id for r in got.collect()] == dealt(rows, limit)


def test_collapse_cap_and_conservation(spark):
    rows = [(1, "g", 5, "New York, NY"), (2, "g", 9, "Dallas, TX"), (3, None, 1, "X"), (4, "g", 9, "New York, NY"), (5, None, 1, None)]
    df = spark.createDataFrame(rows, "id int, g string, score int, place string").withColumn("company", F.col("id").cast("string"))
    g = collapse(df, F.col("g"), "id", [-F.col("score")], "place", ["id", "score", "company"])
    got = {r.requisition: (r.id, r.merged_location, r.n_members) for r in g.collect()}
    assert got == {"g": (2, "Dallas, TX · New York, NY", 3), "alone:3": (3, "X", 1), "alone:5": (5, "", 1)}
    every = members(df, F.col("g"), "id", [-F.col("score")])
    assert every.count() == len(rows) and [r.id for r in every.where("requisition = 'g'").orderBy("member_no").collect()] == [2, 4, 1]
    assert members(df, F.col("g"), "id", [-F.col("score")], g.where("id = 3")).count() == 1
    assert [r.requisition for r in cap_groups(g, "requisition", "company", [Order(F.col("score"), True)], 1).collect()] == ["g"]
    assert cap_groups(g, "requisition", "company", [Order(F.col("score"), True)], 0).count() == 0


def test_merged_location(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", None, ""],), (["a", "b", "c", "d", "e"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(merged_location(F.col("p"))).collect()] == ["a · b · c", "a · b · c +2 more", ""]


def test_distinct_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "n int, k string")
    assert sorted(r.n for r in distinct_first(df, ["k"], [F.col("n").desc()]).collect()) == [2, 4]
