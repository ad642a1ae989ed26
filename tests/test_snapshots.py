import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobweave.operators.snapshots import snapshot_changes

SNAP = "snapshot_no int, delivered_at timestamp, source_name string, source_job_id string, title string, material_version int, key string"
RUN = "run_id long, snapshot_no int, source_name string, status string, started_at timestamp, finished_at timestamp"
T0 = datetime(2026, 1, 1)


def _run(spark, snaps, runs, buckets=3):
    out = snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(runs, RUN), {"title": F.trim(F.coalesce("title", F.lit("")))}, buckets)
    return sorted((r.source, r.snapshot_no, r.source_job_id, r.change_kind) for r in out.collect())


def _runs(spec):
    return [(k, no, s, ok, T0 + timedelta(days=no, minutes=k), T0 + timedelta(days=no, minutes=k + 1)) for k, (s, no, ok) in enumerate(spec)]


def test_kinds_failed_runs_and_late_rows(spark):
    runs = _runs([("a", 0, "SUCCESS"), ("a", 1, "SUCCESS"), ("a", 1, "FAILED"), ("a", 2, "FAILED"), ("a", 2, "SUCCESS"), ("b", 0, "SUCCESS")])
    row = lambda no, i, t, late=0, s="a": (no, T0 + timedelta(days=no, hours=late), s, i, t, 1, "extra")
    snaps = [row(0, "1", "x"), row(0, "2", "y"), row(0, "3", "z"), row(1, "9", "only in a failed one"), row(2, " 1 ", "x "), row(2, "2", "old"), row(2, "2", "new", 100), row(2, "4", None), row(0, "7", "b", s="B "), row(2, None, "no id"), row(2, "  ", "blank id")]
    assert _run(spark, snaps, runs) == [("a", 2, "2", "changed"), ("a", 2, "3", "removed"), ("a", 2, "4", "added")]


def test_empty_tables(spark):
    assert _run(spark, [], []) == []
    assert _run(spark, [(0, T0, "a", "1", "x", 1, "")], []) == []


def test_a_source_that_delivers_nothing_removes_all(spark):
    assert _run(spark, [(0, T0, "a", "1", "x", 1, "")], _runs([("a", 0, "SUCCESS"), ("a", 1, "SUCCESS")])) == [("a", 1, "1", "removed")]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    runs = _runs([(s, no, rnd.choice(["SUCCESS", "SUCCESS", "FAILED"])) for s in "ab" for no in range(6) for _ in range(rnd.choice([1, 2]))])
    snaps = [(no, T0 + timedelta(days=no, seconds=rnd.randrange(9)), s, str(rnd.randrange(12)), rnd.choice("xyz"), rnd.randrange(3), "") for s in "ab" for no in range(6) for _ in range(14)]
    snaps = list({(x[0], x[1], x[2], x[3]): x for x in snaps}.values())
    want = []
    for s in "ab":
        last = {}
        for r in runs:
            if r[2] == s:
                last[r[1]] = r[3]
        good = [no for no in sorted(last) if last[no] == "SUCCESS"]
        state = {no: {x[3]: x[4] for x in sorted((y for y in snaps if y[0] == no and y[2] == s), key=lambda y: y[1])} for no in good}
        for p, n in zip(good, good[1:]):
            want += [(s, n, k, "added") for k in state[n].keys() - state[p].keys()] + [(s, n, k, "removed") for k in state[p].keys() - state[n].keys()]
            want += [(s, n, k, "changed") for k in state[n].keys() & state[p].keys() if state[n][k] != state[p][k]]
    assert _run(spark, snaps, runs, 4) == sorted(want)


def test_full_values_and_later_snapshots_only(spark):
    runs = spark.createDataFrame(_runs([("a", no, "SUCCESS") for no in range(4)]), RUN)
    row = lambda no, i, t, late=0: (no, T0 + timedelta(days=no, hours=late), "a", i, t, 1, "clash")
    snaps = spark.createDataFrame([row(0, "1", "x"), row(0, "2", None), row(1, "1", "y"), row(1, "1", "z", 2), row(1, "2", ""), row(2, "2", "new"), row(3, "2", "new"), row(3, "3", "t")], SNAP)
    values = {"title": F.trim(F.coalesce("title", F.lit("")))}
    got = {(r.snapshot_no, r.source_job_id, r.change_kind, r.old_title, r.new_title) for r in snapshot_changes(snaps, runs, values, 2, full=True).collect()}
    assert got == {(1, "1", "changed", "x", "z"), (2, "1", "removed", "z", None), (2, "2", "changed", "", "new"), (3, "3", "added", None, "t")}
    late = {(r.snapshot_no, r.source_job_id, r.change_kind) for r in snapshot_changes(snaps, runs, values, 2, since=2).collect()}
    assert late == {(3, "3", "added")} and snapshot_changes(snaps, runs, values, 2, since=3).count() == 0
