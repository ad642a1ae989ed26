from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobweave.functions import identity
from jobweave.functions.text import normalize_text
from jobweave.operators import joins, metrics, sinks, state
from jobweave.schema import JOB_STATE

NOW = datetime(2026, 6, 1)


def now():
    return F.lit(str(NOW)).cast("timestamp")


def job(i, status="OPEN", closed=None, sent=None, version=1, print_="f", seen=None):
    seen = seen or NOW - timedelta(days=1)
    return (i, "k" + i, "u", "c", "t", "l", "y", "s" + i, "old text", status, print_, version, seen, seen, closed, None, sent)


def merged(spark, old, new):
    schema = "id string, stored_id string, canonical_key string, canonical_url string, company string, title string, location string, cycle string, source_job_id string, description string, status string, material_fingerprint string"
    incoming = spark.createDataFrame([(i, s, "k", "u", "c", "t", "l", "y", "s", None, st, f) for i, s, st, f in new], schema)
    return {r.id: r for r in state.merge_state(spark.createDataFrame(old, JOB_STATE), incoming, now()).collect()}


def test_merge(spark):
    old = [job("a", sent=NOW), job("b", "CLOSED", NOW - timedelta(days=40), NOW), job("c", "CLOSED", NOW - timedelta(days=3), NOW), job("d"), job("e")]
    got = merged(spark, old, [("a", "a", "OPEN", "g"), ("b", "b", "OPEN", "f"), ("c", "c", "OPEN", "f"), ("d", "d", "CLOSED", "f"), ("n", None, "OPEN", "f")])
    assert (got["a"].material_version, got["a"].sent_at, got["a"].description) == (2, NOW, "old text")
    assert (got["b"].material_version, got["b"].sent_at, got["b"].closed_at, got["b"].reopened_at) == (2, None, None, NOW)
    assert (got["c"].material_version, got["c"].sent_at) == (1, NOW)
    assert (got["d"].status, got["d"].closed_at) == ("CLOSED", NOW) and (got["e"].last_seen_at, got["e"].status) == (NOW - timedelta(days=1), "OPEN")
    assert (got["n"].material_version, got["n"].first_seen_at) == (1, NOW)
    assert merged(spark, [], []) == {}


def test_close_stale(spark):
    jobs = spark.createDataFrame([job("a", seen=NOW - timedelta(hours=80)), job("b", seen=NOW - timedelta(hours=80)), job("c", seen=NOW - timedelta(hours=10))], JOB_STATE)
    seen = spark.createDataFrame([("b", NOW - timedelta(hours=1))], "job_id string, scraped_at timestamp")
    assert {r.id: r.status for r in state.close_stale(jobs, seen, now()).collect()} == {"a": "CLOSED", "b": "OPEN", "c": "OPEN"}


def test_cadence_and_watermarks(spark):
    marks = spark.createDataFrame([("a", "w", NOW - timedelta(hours=5)), ("b", "w", NOW - timedelta(hours=7))], "source_name string, watermark string, updated_at timestamp")
    due = state.due_sources(spark.createDataFrame([("a", 6), ("b", 6), ("c", 6)], "source_name string, cadence_hours int"), marks, now())
    assert sorted(r.source_name for r in due.collect()) == ["b", "c"]
    runs = spark.createDataFrame([("a", "SUCCESS", NOW), ("b", "FAILED", NOW)], "source_name string, status string, finished_at timestamp")
    after = state.advance_watermarks(marks, runs, spark.createDataFrame([("a", "2026-05-01")], "source_name string, posted_at string"))
    assert {r.source_name: r.watermark for r in after.collect()} == {"a": "2026-05-01", "b": "w"}


def test_pages(spark):
    schema = "url string, content_hash string, checked_at timestamp"
    nxt, changes = state.page_changes(spark.createDataFrame([("a", "1", NOW), ("b", "1", NOW), ("d", "", NOW)], schema), spark.createDataFrame([("a", "2", NOW), ("b", "", NOW), ("c", "9", NOW), ("d", "5", NOW)], schema))
    assert {r.url: r.content_hash for r in nxt.collect()} == {"a": "2", "b": "1", "c": "9", "d": "5"} and [r.url for r in changes.collect()] == ["a"]


def test_claims(spark, tmp_path):
    store = state.SnapshotStore(spark, str(tmp_path / "batches"))
    with store.lock():
        assert state.claim_batch(store, "k1", "h", ["1"], "2026-06-01 00:00:00") == "k1"
        with pytest.raises(FileExistsError), store.lock():
            pass
        assert state.claim_batch(store, "k2", "h", ["1"], "2026-06-01 00:30:00") is None
        assert state.claim_batch(store, "k3", "h", ["1"], "2026-06-01 02:00:00") == "k1"
        assert state.confirm_batch(store, "k1", "2026-06-01 02:01:00") == 1 and state.confirm_batch(store, "k1", "2026-06-01 02:02:00") == 0
        assert state.claim_batch(store, "k4", "h", ["1"], "2026-07-01 00:00:00") is None
    with store.lock():
        pass


def test_sources_merge_and_restore(spark):
    schema = "job_id string, source_name string, source_job_id string, source_url string, updated_at timestamp"
    old, new = spark.createDataFrame([("j1", "s", "1", "u1", NOW - timedelta(1))], schema), spark.createDataFrame([("j2", "s", "1", "u1", NOW), ("j2", "s", None, "u1", NOW - timedelta(2))], schema)
    assert [(r.job_id, r.source_job_id) for r in state.merge_sources(old, new).collect()] == [("j2", "1")]
    jobs = spark.createDataFrame([("1", None), ("2", None)], "id string, sent_at timestamp")
    batches = spark.createDataFrame([(["1"], "SENT", NOW), (["1", "2"], "CLAIMED", NOW)], "job_ids array<string>, status string, sent_at timestamp")
    assert {r.id: r.sent_at for r in state.restore_sent(jobs, batches).collect()} == {"1": NOW, "2": None}


def test_transition(spark):
    df = spark.createDataFrame([(None, "OPEN"), (("CLOSED", "x", 3), "OPEN"), (("OPEN", "x", 3), "CLOSED")], "p struct<status:string,sent_at:string,material_version:int>, n string")
    assert [tuple(r[0]) for r in df.select(state.transition(F.col("p"), F.col("n"))).collect()] == [("OPEN", None, 1), ("OPEN", None, 4), ("CLOSED", "x", 3)]


def test_overrides_and_aliases(spark):
    rows = spark.createDataFrame([(1, "c", "i", None), (2, "c", None, "http://u"), (3, "d", "i", None)], "id int, company string, sid string, url string")
    o = spark.createDataFrame([(2, "c", "i", None, "late"), (1, "c", "i", None, "first"), (3, "c", None, "http://u", "by url")], "ordinal int, company string, source_job_id string, canonical_url string, verdict string")
    assert {r.id: r.override for r in joins.first_override(rows, "id", "company", "sid", "url", o).collect()} == {1: "first", 2: "by url", 3: None}
    low, high = spark.createDataFrame([("a", "A1"), ("b", "B1")], "alias string, canonical string"), spark.createDataFrame([("a", "A2"), (None, "x")], "alias string, canonical string")
    got = joins.resolve_alias(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), "k", joins.alias_table(low, high))
    assert {r.k: r.resolved for r in got.collect()} == {"a": "A2", "b": "B1", "c": "c", None: None}


def test_metrics_and_sinks(spark):
    items = spark.createDataFrame([(f"c{k}", 10 if k < 4 else 1) for k in range(9)], "name string, priority int")
    got = [r.name for r in metrics.rotate(items, "name", "priority", 1, 4).orderBy("cohort_no").collect()]
    assert got == ["c2", "c3", "c6", "c7"] and metrics.rotate(items, "name", "priority", 1, 20).count() == 9
    assert metrics.coverage(items.limit(0), items.limit(0), "name").first().percent == 0
    rows = spark.createDataFrame([("S", 1, "T<", "C", None, "Apply", "http://u", 2), ("S", 1, "A", "C", "p", "Apply", None, 1)], "section string, section_no int, title string, company string, place string, label string, url string, o int")
    d = sinks.render_digest(rows, [F.col("o").alias("o")]).first()
    assert d.n_roles == 2 and d.text.startswith("S\nA · C") and "T&lt;" in d.html
    p = sinks.ledger_payload(spark.createDataFrame([("1", "Title", "nope", 3)], "id string, t string, s string, n int"), {"Name": ("title", "t"), "Kind": ("select", "s"), "N": ("number", "n")}, {"Kind": ["yes"]}).first().payload
    assert p == '{"properties":{"Name":{"title":[{"text":{"content":"Title"}}]},"N":{"number":3}}}'
    assert sorted(r.v for r in sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), "k").collect()) == ["a", "c"]


def test_listing_match_against_brute_force(spark):
    names = ["Tujurafu", "tujurafu.example", "Acme", "AcmeSystems", "Acme Systems", "me sys", "cm", "Cm", "the acme systems of old", "Beta Bank", "betabank", "  ", "???", None]
    titles = ["Software Engineer Intern, Storage", "Storage Software Engineer Internship", "Data Analyst", None]
    listings = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate((n, t) for n in names for t in titles)], "listing_id int, name string, title string")
    postings = spark.createDataFrame([(100 + k, n, t, (k * 37) % 101) for k, (t, n) in enumerate((t, n) for t in titles for n in names[::-1])], "posting_id int, name string, title string, ordinal int")
    pairs = listings.alias("l").crossJoin(postings.alias("p"))
    plain = lambda c: normalize_text(F.col(c))
    pairs = pairs.where(identity.same_employer(plain("l.name"), plain("p.name")) & identity.describes_same_role(F.col("l.title"), F.col("p.title")))
    want = {r.listing_id: r.posting_id for r in pairs.groupBy("listing_id").agg(F.min_by("posting_id", "ordinal").alias("posting_id")).collect()}
    assert {r.listing_id: r.posting_id for r in joins.first_listing_match(listings, postings).collect()} == want
    alone = joins.first_listing_match(listings.where("name = 'Tujurafu'"), postings.where("name = 'tujurafu.example'"))
    assert alone.count() == 3 and joins.first_listing_match(listings.limit(0), postings).count() == 0


def test_merge_takes_the_new_texts(spark):
    schema = "id string, canonical_key string, canonical_url string, company string, title string, location string, cycle string, source_job_id string, description string, status string, material_fingerprint string"
    old = spark.createDataFrame([("a", "k", "u", "Acme", "Old title", "NY", "Fall 2026", "1", "d", "OPEN", "f1")], schema).withColumns({"material_version": F.lit(1), "first_seen_at": F.lit("2026-01-01").cast("timestamp"), "last_seen_at": F.lit("2026-01-01").cast("timestamp"), "closed_at": F.lit(None).cast("timestamp"), "reopened_at": F.lit(None).cast("timestamp"), "sent_at": F.lit(None).cast("timestamp")})
    new = spark.createDataFrame([("x", "k2", "u2", "Acme Inc", "Middle", "LA", "Fall 2026", "2", None, "OPEN", "f2", "a"), ("y", "k3", None, "Acme Corp", "New title", "SF", None, "2", None, None, "f3", "a")], schema + ", stored_id string")
    r = state.merge_state(old, new, F.lit("2026-02-01").cast("timestamp")).first()
    assert (r.id, r.canonical_key, r.company, r.title, r.location, r.cycle, r.description, r.material_version, r.material_fingerprint, r.status, r.source_job_id) == ("a", "k", "Acme Corp", "New title", "SF", "Fall 2026", "d", 2, "f3", "OPEN", "1")


def test_small_state_filters(spark):
    now = F.lit("2026-02-01").cast("timestamp")
    o = spark.createDataFrame([(1, None), (2, "2026-01-01"), (3, "2026-03-01")], "k int, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    assert sorted(r.k for r in state.unexpired(o, now).collect()) == [1, 3]
    j = spark.createDataFrame([(1, "OPEN", None), (2, "CLOSED", None), (3, "OPEN", "2026-01-01")], "id int, status string, s string").withColumn("sent_at", F.col("s").cast("timestamp"))
    assert [r.id for r in state.unsent(j).collect()] == [1]
    b = spark.createDataFrame([("k", "SENT", ["1", "9"]), ("q", "CLAIMED", ["2"])], "batch_key string, status string, job_ids array<string>").withColumn("sent_at", now)
    assert {r.id: r.sent_at is not None for r in state.stamp_sent(j, b, "k").collect()} == {1: True, 2: False, 3: True} and state.stamp_sent(j, b, "q").where("sent_at is not null").count() == 1
    runs = spark.createDataFrame([("a", "SUCCESS", None), ("b", "FAILED", "timeout"), ("c", "SKIPPED", "not due"), ("d", "degraded", None)], "source_name string, status string, error_message string")
    assert sorted(r.note for r in sinks.degraded(runs).collect()) == ["b: timeout", "d: DEGRADED"]
    rows = spark.createDataFrame([("S", 1, "T & U", "Acme", "NY", "Apply", "http://x", ["Go"], 1)], "section string, section_no int, title string, company string, place string, label string, url string, skills array<string>, o int")
    changes = spark.createDataFrame([("Acme", "Careers", "http://p")], "company string, label string, url string")
    d = sinks.render_digest(rows, [F.col("o").alias("o")], changes=changes, notes=sinks.degraded(runs)).first()
    assert d.subject == "New roles: 1 roles" and "Skills: Go" in d.text and "- Acme - Careers: http://p" in d.text and "- b: timeout" in d.text and "<li>d: DEGRADED</li>" in d.html and "T &amp; U" in d.html
    empty = sinks.render_digest(rows.limit(0), [F.col("o").alias("o")], changes=changes).first()
    assert empty.subject == "Page updates: 1 changed" and empty.n_roles == 0
    assert spark.range(1).select(sinks.status_patch("Status", F.lit("Closed")).alias("p")).first().p == '{"properties":{"Status":{"select":{"name":"Closed"}}}}'


def test_pages_that_give_nothing_fail(spark):
    from jobweave.sources.pages import page_runs

    docs = spark.createDataFrame([("a", "x" * 3000), ("b", "x"), ("c", None), ("d", "y" * 5000)], "source_name string, document string")
    got = {r.source_name: (r.status, r.fetched_count) for r in page_runs(docs, spark.createDataFrame([("d",)], "source_name string"), 2000).collect()}
    assert got == {"a": ("FAILED", 0), "b": ("SUCCESS", 0), "c": ("SUCCESS", 0), "d": ("SUCCESS", 1)}
