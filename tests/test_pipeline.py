import json

from pyspark.sql import functions as F

from jobweave.operators.enrich import apply_verdicts, page_verdicts, pending, seen_addresses
from jobweave.operators.state import SnapshotStore
from jobweave.plans.pipeline import Stores, confirm, run_batch, run_persistent
from jobweave.schema import EXCLUSION, RAW_POSTING
from jobweave.sources.landing import cap_per_source, landed, read_fixture

BASE = {"sourceName": "s", "company": "Acme Inc", "location": "NY, NY", "sourceUrl": "https://s.example", "scrapedAt": "2026-01-01T00:00:00Z"}
ROWS = [
    BASE | {"sourceJobId": "1", "title": "Software Engineer Intern - Summer 2027", "directApplyUrl": "https://jobs.lever.co/acme/1?utm_source=a"},
    BASE | {"sourceName": "list", "title": "SWE Intern (Summer 2027)", "directApplyUrl": "https://www.jobs.lever.co/acme/1"},
    BASE | {"sourceJobId": "3", "title": "Data Engineer Intern - Summer 2027", "location": "Dallas, TX"}, BASE | {"sourceJobId": "4", "title": "Data Engineer Intern - Summer 2027", "location": "Boston, MA"},
    BASE | {"sourceJobId": "5", "title": "Quant Intern", "status": "CLOSED"}, BASE | {"sourceJobId": "6", "title": "Already Applied Analyst Intern"}, BASE | {"sourceJobId": "7", "title": "Sent Robotics Intern - Fall 2026"}, {"sourceName": "s", "title": "not valid"},
]

for _k, _r in enumerate(ROWS[:-1]):
    _r["sourceUrl"] = f"https://s.example/{_k}"


def test_fixture_batch(spark, tmp_path):
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps(ROWS))
    raw = read_fixture(spark, str(path)).withColumn("id", F.monotonically_increasing_id())
    assert raw.count() == 7
    aliases = spark.createDataFrame([("acme", "Acme Holdings")], "alias string, canonical string")
    excluded = spark.createDataFrame([("p", "acme holdings", "already applied analyst intern", None, None)], EXCLUSION)
    sent = spark.createDataFrame([("acme holdings|Fall 2026|robot.sent",), (None,)], "signature string")
    b = run_batch(raw, "id", aliases, excluded, sent, F.lit("All"), ["All"], 10)
    assert b.report.first().asDict() == {"raw": 7, "accepted": 3, "rejected": 2, "deduplicated": 1, "applied_excluded": 1}
    assert {r.reason: r.n for r in b.reasons.collect()} == {"closed": 1, "already_applied": 1, "requisition_already_sent": 1}
    groups = {r.title: (r.merged_location, r.n_members) for r in b.groups.collect()}
    assert groups == {"Software Engineer Intern - Summer 2027": ("NY, NY", 1), "Data Engineer Intern - Summer 2027": ("Dallas, TX · Boston, MA", 2)}
    assert b.members.count() == 3 and b.digest.first().n_roles == 2
    again = run_batch(raw, "id", aliases, excluded, b.classified.select(F.col("requisition").alias("signature")), F.lit("All"), ["All"], 10)
    assert again.members.count() == 0


def test_persistent_runs(spark, tmp_path):
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps(ROWS[:5]))
    raw = read_fixture(spark, str(path)).withColumn("id", F.monotonically_increasing_id())
    aliases, excluded, none = spark.createDataFrame([("acme", "Acme Holdings")], "alias string, canonical string"), spark.createDataFrame([], EXCLUSION), spark.createDataFrame([], "signature string")
    stores = Stores(*[SnapshotStore(spark, f"file://{tmp_path}/{n}") for n in ("jobs", "sources", "batches")])
    make = lambda rows: run_batch(rows, "id", aliases, excluded, none, F.lit("All"), ["All"], 10)
    first = make(raw)
    key = run_persistent(first, stores, "2026-01-01 00:00:00")
    assert key and first.report.first().asDict() == {"raw": 5, "accepted": 3, "rejected": 1, "deduplicated": 1, "applied_excluded": 0}
    # unconfirmed, the same batch is claimed already; confirmed, nothing is left to report
    assert run_persistent(make(raw), stores, "2026-01-01 00:10:00") is None
    assert confirm(stores, key, "2026-01-01 00:20:00") == 1 and confirm(stores, key, "2026-01-01 00:21:00") == 0
    again = make(raw)
    assert run_persistent(again, stores, "2026-01-02 00:00:00") is None and again.report.first()["accepted"] == 0
    jobs = stores.jobs.current()
    assert jobs.where("sent_at is not null").count() == 3 == jobs.count() and {r.material_version for r in jobs.collect()} == {1}
    # what no source has any more is closed; what is new is reported alone
    extra = raw.limit(1).withColumn("title", F.lit("Robotics Engineer Intern - Fall 2026")).withColumn("source_job_id", F.lit("77")).withColumn("direct_apply_url", F.lit("https://jobs.lever.co/acme/77")).withColumn("id", F.lit(99).cast("long"))
    late = make(extra)
    assert run_persistent(late, stores, "2026-01-09 00:00:00") and late.members.count() == 1
    assert {r.status: r.n for r in stores.jobs.current().groupBy("status").agg(F.count("*").alias("n")).collect()} == {"CLOSED": 3, "OPEN": 1}


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1,\n2]")
    rows = landed(spark, str(tmp_path), spark.createDataFrame([("a.json", "a"), ("missing.json", "b")], "file string, source_name string")).collect()
    assert {r.source_name: r.payload for r in rows} == {"a": "[1,\n2]", "b": ""}
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "source_name string, n int")
    assert cap_per_source(df, "n", 2).count() == 3 and spark.createDataFrame([], RAW_POSTING).count() == 0


def test_enrichment(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>" + "words and visa " * 40), (2, "http://b", "short"), (3, None, None)], "id int, url string, html string")
    v = page_verdicts(pages, F.when(F.contains(F.col("text"), F.lit("visa")), "YES"))
    got = {r.id: (r.http_ok, r.verdict) for r in v.collect()}
    assert got == {1: (True, "YES"), 2: (True, "UNKNOWN"), 3: (False, "UNKNOWN")}
    jobs = spark.createDataFrame([(1, "MAYBE", ""), (2, "MAYBE", "own"), (9, "MAYBE", None)], "id int, status string, summary string")
    filled = {r.id: (r.status, (r.summary or "")[:5]) for r in apply_verdicts(jobs, v, "status", ["summary"]).collect()}
    assert filled == {1: ("YES", "words"), 2: ("MAYBE", "own"), 9: ("MAYBE", "")} and [r.id for r in pending(jobs, v).collect()] == [9]
    assert seen_addresses(jobs, spark.createDataFrame([(1, "u"), (1, "u"), (2, None), (7, "x")], "job_id int, direct_apply_url string")).count() == 1
