"""Typed state and timers of streams, against the same machines in a batch."""

import time

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import batching, replay
from tarnflow.sources.tables import event_stream
from tarnflow.streaming.stateful import run_available
from tarnflow.streaming.timers import batch_stream, step_stream, use_rocksdb

REQUESTS = "stream_id long, seq long, at_us long, key string"


@pytest.fixture(autouse=True)
def small_store(spark):
    use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, path, rows):
    spark.createDataFrame(rows, REQUESTS).withColumn("ts", F.timestamp_micros("at_us")).coalesce(1).write.mode("append").parquet(path)


def live(spark, path):
    return spark.readStream.schema(REQUESTS + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, tmp_path, size, wait_us, service_us):
    out = batch_stream(live(spark, str(tmp_path / "in")), size, wait_us, service_us)
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return {(r.stream_id, r.seq): (r.batch, r.place, r.closed_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_a_half_full_batch_closes_at_its_deadline(spark, tmp_path):
    """No further row of stream 1 comes; another stream moves the watermark.  State outlives the first run."""
    second = 1_000_000
    put(spark, str(tmp_path / "in"), [(1, 0, 10 * second, "a"), (1, 1, 11 * second, "a")])
    assert run(spark, tmp_path, 4, 10 * second, 0) == {}
    put(spark, str(tmp_path / "in"), [(2, 0, 60 * second, "a")])
    assert run(spark, tmp_path, 4, 10 * second, 0) == {(1, 0): (0, 0, 20 * second), (1, 1): (0, 1, 20 * second)}
    # the number of the batch goes on, and stream 2 still waits
    put(spark, str(tmp_path / "in"), [(1, 2, 61 * second, "a"), (3, 0, 65 * second, "a")])
    assert len(run(spark, tmp_path, 4, 10 * second, 0)) == 2
    put(spark, str(tmp_path / "in"), [(3, 1, 600 * second, "a")])
    found = run(spark, tmp_path, 4, 10 * second, 0)
    assert found[1, 2] == (1, 0, 71 * second) and found[2, 0] == (0, 0, 70 * second) and found[3, 0] == (0, 0, 75 * second)
    assert (3, 1) not in found


def test_events_in_two_micro_batches_equal_the_batch(spark, tmp_path):
    rows = event_stream(spark, "/root/testdata/sf0.001").select("stream_id", "seq", "at_us", F.col("event_type").alias("key")).collect()
    hour = 3_600_000_000
    cut = sorted(r.at_us for r in rows)[len(rows) // 2]
    put(spark, str(tmp_path / "in"), [tuple(r) for r in rows if r.at_us < cut])
    put(spark, str(tmp_path / "in"), [*(tuple(r) for r in rows if r.at_us >= cut), (-1, 0, max(r.at_us for r in rows) + 10_000 * hour, "end")])
    want = batching.collect_batches(spark.createDataFrame(rows, REQUESTS), 4, 40 * hour, 10 * hour).collect()
    assert run(spark, tmp_path, 4, 40 * hour, 10 * hour) == {(r.stream_id, r.seq): (r.batch, r.place, r.closed_us) for r in want}


def test_clocks_end_a_wait(spark, tmp_path):
    """By arrival: a second trigger without rows closes the batch."""
    put(spark, str(tmp_path / "in"), [(1, 0, 0, "a"), (1, 1, 5, "a")])
    out = batch_stream(live(spark, str(tmp_path / "in")), 4, 500_000, 0, arrival=True)
    going = out.writeStream.format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("clocked").count() == 2:
                break
            time.sleep(0.5)
        assert sorted((r.seq, r.batch, r.place) for r in spark.table("clocked").collect()) == [(0, 0, 0), (1, 0, 1)]
    finally:
        going.stop()


def test_steps_with_typed_state_equal_replay(spark, tmp_path):
    rows = event_stream(spark, "/root/testdata/sf0.001").where("stream_id < 12").select("stream_id", "seq", "at_us", "service_us", (F.col("event_type") == "error").alias("failed"))
    rows.where("seq < 8").coalesce(1).write.parquet(str(tmp_path / "in"))
    time.sleep(0.01)
    rows.where("seq >= 8").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cases = {
        "backed": (replay.back_off(30 * 3_600_000_000), "seq long, outcome string", "retry_us long, open boolean", lambda: (None, False)),
        "tapped": (replay.busy_skip, "seq long, taken boolean", "free_us long", lambda: None),
    }
    for name, (step, schema, state, start) in cases.items():
        out = run_available(step_stream(source, step, schema, state, start=start), name, str(tmp_path / name))
        want = replay.replay(rows, step, schema, start=start)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_silent_streams_begin_anew(spark, tmp_path):
    """What a stream left behind ends by itself; a query that looks at clocks goes on until it is stopped."""
    schema = "stream_id long, seq long, at_us long, service_us long"
    add = lambda *row: spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(1, 0, 0, 10**9)
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = step_stream(source, replay.busy_skip, "seq long, taken boolean", "free_us long", ttl_ms=50)
    going = out.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for n in (1, 2):
            for _ in range(60):
                if spark.table("silent").count() == n:
                    break
                time.sleep(0.5)
            assert spark.table("silent").count() == n
            if n == 1:
                time.sleep(1)
                add(1, 1, 5, 1)
        assert all(r.taken for r in spark.table("silent").collect())
    finally:
        going.stop()
