import random
from datetime import datetime, timedelta

from jobweave.streaming.feeds import dedup_within_watermark, sessions, stale_closer, stale_events, tumbling_counts

T0 = datetime(2026, 1, 1)


def _write(spark, path, rows):
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def _collect(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}")


def test_stale_closer_equals_its_batch_form(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted(((u, T0 + timedelta(hours=rnd.randrange(600))) for u in range(5) for _ in range(8)), key=lambda r: r[1])
    rows.append((99, T0 + timedelta(hours=900)))
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 10):
        _write(spark, path, rows[k : k + 10])
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r.user_id, r.event, r.at) for r in _collect(spark, stale_closer(stream, "user_id", "ts", "1000 hours", 72), "stale").collect() if r.user_id != 99)
    want = sorted((r.user_id, r.event, r.at) for r in stale_events(spark.createDataFrame(rows, "user_id long, ts timestamp"), "user_id", "ts", str(T0 + timedelta(hours=900)), 72).collect() if r.user_id != 99)
    opened = [x for x in want if x[1] == "OPENED"]
    assert [x for x in got if x[1] == "OPENED"] == opened and set(got) <= set(want)


def test_windows_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [(1, T0), (1, T0 + timedelta(minutes=5)), (1, T0), (2, T0 + timedelta(hours=9)), (3, T0 + timedelta(days=3))])
    stream = lambda: spark.readStream.schema("user_id long, ts timestamp").parquet(path)
    assert _collect(spark, dedup_within_watermark(stream(), ["user_id"], "ts", "1 day"), "dedup").count() == 3
    assert sorted((r.user_id, r.n) for r in _collect(spark, tumbling_counts(stream(), "ts", "1 day", "1 hour", ["user_id"]), "tumble").collect()) == [(1, 3), (2, 1)]
    assert sorted((r.user_id, r.n) for r in _collect(spark, sessions(stream(), "ts", "1 hour", "1 hour", "user_id"), "sess").collect()) == [(1, 3), (2, 1)]
