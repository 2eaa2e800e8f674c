"""Retry, live settings, sinks and reports of running queries."""

import time

import pytest
from pyspark.sql import functions as F

from tarnflow.plans.watch import LiveSettings
from tarnflow.operators.recovery import fatal
from tarnflow.sources.live import keep_running, publish, publish_packets
from tarnflow.sources.packets import generations
from tarnflow.streaming.observed import Report, observed
from tarnflow.streaming.windows import interval_report, sessions
from tarnflow.streaming.stateful import run_available


def test_fatal_looks_at_causes():
    error = ValueError("outer")
    error.__cause__ = RuntimeError("CUDA error: x")
    loop = ValueError("a")
    loop.__context__ = ValueError("b")
    loop.__context__.__context__ = loop
    assert fatal(error) and not fatal(loop) and fatal(MemoryError())


def test_runs_again_until_fatal():
    seen, waits = [], []
    steps = iter([None, ValueError("lost"), RuntimeError("device lost")])

    def start():
        e = next(steps)
        if e:
            raise e

    with pytest.raises(RuntimeError):
        keep_running(start, wait_s=3, failed=seen.append, sleep=waits.append)
    assert len(seen) == 2 and waits == [3, 3]


def test_settings_that_are_refused_are_not_tried_again():
    text, now, taken, tries = ["A:\n  x: 1"], [0.0], [], []

    def apply(found):
        tries.append(found)
        if found.get("A", {}).get("x") == 2:
            return False
        taken.append(found)
        return True

    live = LiveSettings(lambda: text[0], apply, clock=lambda: now[0])
    assert live.check() and not live.check()
    for change, ok in (("A:\n  x: 2", False), ("A:\n  x: 2", False), ("nonsense: [", False), ("A:\n  x: 3", True), ("A:\n  x: 3", False)):
        now[0] += 1
        text[0] = change
        assert live.check() is ok
    assert [t["A"]["x"] for t in taken] == [1, 3] and len(tries) == 3


def test_watched_settings_are_read_when_told():
    text, now, reads, watched = ["A:\n  x: 1"], [0.0], [0], [True]

    def read():
        reads[0] += 1
        if text[0] is None:
            raise OSError("gone")
        return text[0]

    live = LiveSettings(read, lambda found: True, clock=lambda: now[0], watched=lambda: watched[0])
    assert live.check() and reads[0] == 1
    now[0], text[0] = 29.0, "A:\n  x: 2"
    assert not live.check() and reads[0] == 1
    live.changed()
    assert live.check() and reads[0] == 2
    now[0] = 60.0
    assert not live.check() and reads[0] == 3
    text[0], now[0] = None, 61.0
    live.changed()
    assert not live.check() and not live.check() and reads[0] == 5
    text[0] = "A:\n  x: 3"
    assert live.check()
    watched[0], now[0], text[0] = False, 61.6, "A:\n  x: 4"
    assert live.check()


def events(spark, tmp_path):
    rows = spark.range(60).select(
        F.timestamp_seconds(F.col("id") * 30 + F.when(F.col("id") >= 40, 600).otherwise(0)).alias("ts"),
        (F.col("id") % 2).alias("user_id"), (F.col("id") / 1.0).alias("value"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_interval_report_equals_batch(spark, tmp_path):
    rows, live = events(spark, tmp_path)
    out = run_available(interval_report(live, "5 minutes", "1 minute"), "intervals", str(tmp_path / "c"), "complete")
    batch = rows.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    assert sorted(map(tuple, out.collect())) == sorted((r.w.start, r.n, r["mean"]) for r in batch.collect())


def test_sessions_end_in_silence(spark, tmp_path):
    _, live = events(spark, tmp_path)
    out = run_available(sessions(live, "5 minutes", "1 minute"), "sessions", str(tmp_path / "c"), "complete")
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(0, 10), (0, 20), (1, 10), (1, 20)]


def test_report_and_sink(spark, tmp_path):
    rows, live = events(spark, tmp_path)
    report = Report("frames")
    spark.streams.addListener(report)
    try:
        marked = observed(live, "frames", F.col("value")).withColumn("generation", F.col("user_id"))
        publish(marked, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if report.rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(report)
    assert report.rows[0]["frames"] == 60 and report.rows[0]["avg_ms"] == 29500.0
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("generation").count().count() == 2
    assert rows.count() == 60


def test_publisher_as_a_sink(spark, tmp_path):
    schema = "stream_id long, seq long, at_us long, key long, valid boolean, opens boolean, writes boolean, dts long, pts long, duration long, num long, den long"
    for part in ([(0, 9000), (1, 9000), (2, 6000)], [(3, 8000), (4, None), (5, 99999)]):
        rows = [(1, i, i, 0, True, True, True, d, None, 3000, 1, 90000) for i, d in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    publish_packets(live, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.seq, r.dts) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 9000), (4, 12000), (5, 99999)]


def test_generations(spark):
    df = spark.createDataFrame([(0, i, i in (2, 5)) for i in range(7)], "stream_id long, seq long, new boolean")
    assert [r.g for r in generations(df, "g", F.col("new")).orderBy("seq").collect()] == [0, 0, 1, 1, 1, 2, 2]
