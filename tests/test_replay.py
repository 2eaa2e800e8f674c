"""State machines: cases, brute force, and the same rows from a stream."""

import random

from pyspark.sql import functions as F

from tarnflow.operators import batching, replay
from tarnflow.streaming.stateful import replay_stream, run_available


def test_slow_first_row(spark):
    rows = [(0, i, i * 10, 10_000_000, False, None) for i in range(101)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, at_us long, service_us long, failed boolean, released_after_us long")
    out = replay.replay(df, replay.deadline(100_000), "seq long, outcome string, emitted boolean", start=lambda: None)
    got = {r.seq: (r.outcome, r.emitted) for r in out.collect()}
    assert got[0] == ("timeout", False)
    assert all(got[i] == ("busy", True) for i in range(1, 101))


def test_released_input_passes(spark):
    rows = [(0, 0, 0, 90, False, 5), (0, 1, 200, 5, True, None)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, at_us long, service_us long, failed boolean, released_after_us long")
    out = replay.replay(df, replay.deadline(10), "seq long, outcome string, emitted boolean", start=lambda: None)
    assert {r.seq: (r.outcome, r.emitted) for r in out.collect()} == {0: ("timeout", True), 1: ("error", True)}


def test_missing_dts_goes_on(spark):
    rows = [(0, 0, 0, None, 1, 90000, 3000), (0, 1, None, None, 1, 90000, 3000), (0, 2, 3000, None, 1, 90000, 3000)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, dts long, pts long, num int, den int, duration long")
    out = replay.replay(df, replay.chained_dts, "seq long, dts long", start=lambda: None)
    assert sorted((r.seq, r.dts) for r in out.collect()) == [(0, 0), (1, 3000)]


def test_queue_drops_oldest():
    queue, out = replay.DropOldest(2), []
    state = queue.start()
    for i in range(5):
        state, made = queue.step(state, {"seq": i, "at_us": i, "service_us": 100})
        out += made
    out += queue.finish(state)
    assert [x[0] for x in out] == [0, 3, 4] and out[-1][2] == 2


def simulate(rows, size, wait, service):
    """Tick by tick: what a worker with a queue does."""
    rows, put_off, free, out = list(rows), [], None, []
    while rows or put_off:
        seed = put_off.pop(0) if put_off else rows.pop(0)
        now = seed[1] if free is None else max(free, seed[1])
        batch, last = [seed], seed[1] + wait
        while len(batch) < size:
            if rows and rows[0][1] <= now:
                row = rows.pop(0)
                (batch if row[2] == seed[2] else put_off).append(row)
            elif now < last:
                now += 1
            else:
                break
        out.append([r[0] for r in batch])
        free = now + service
    return out


def test_batches_against_simulation():
    rng = random.Random(11)
    for _ in range(400):
        at, rows = 0, []
        for i in range(rng.randrange(1, 12)):
            at += rng.randrange(0, 5)
            rows.append((i, at, rng.choice("ab")))
        size, wait, service = rng.randrange(1, 4), rng.randrange(0, 6), rng.randrange(0, 8)
        machine = replay.Batcher(size, wait, service)
        state, made = machine.start(), []
        for seq, at_us, key in rows:
            state, out = machine.step(state, {"seq": seq, "at_us": at_us, "key": key})
            made += out
        made += machine.finish(state)
        batches = {}
        for seq, batch, place, _ in made:
            batches.setdefault(batch, []).append((place, seq))
        assert [[s for _, s in sorted(b)] for _, b in sorted(batches.items())] == simulate(rows, size, wait, service)


def test_batches_of_two(spark):
    df = spark.createDataFrame([(0, 0, 0, "k"), (0, 1, 5, "k")], "stream_id long, seq long, at_us long, key string")
    out = batching.collect_batches(df, 2, 1000, 10).collect()
    assert sorted((r.seq, r.batch, r.place) for r in out) == [(0, 0, 0), (1, 0, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rng, at, rows = random.Random(2), 0, []
    for i in range(300):
        at += rng.randrange(1, 20)
        rows.append((i % 7, i, at, rng.randrange(1, 60)))
    df = spark.createDataFrame(rows, "stream_id long, seq long, at_us long, service_us long")
    for part in range(3):
        df.where(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "seq long, taken boolean"
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = run_available(replay_stream(live, replay.busy_skip, schema, start=lambda: None), "busy", str(tmp_path / "check"))
    batch = replay.replay(df, replay.busy_skip, schema, start=lambda: None)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_keeps_values_and_ends(spark, tmp_path):
    """Large whole numbers, nulls and NaN come through; a stream that falls silent gives what it held."""
    big = 2**53 + 1
    rows = [(0, 1, big, float("nan"), 10), (0, 2, None, 1.0, 20), (1, 1, big, None, 15)]
    later = [(2, 9, 0, 0.0, 4000)]
    for part in (rows, later, [(2, 10, 0, 0.0, 8000)]):
        df = spark.createDataFrame(part, "stream_id long, at_us long, big long, x double, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def step(held, row):
        return [*held, (row["at_us"], row["big"], repr(row["x"]))], []

    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = replay_stream(live, step, "at_us long, big long, x string", start=list, finish=lambda held: held, at="ts", idle_ms=60_000)
    got = sorted((r.stream_id, r.at_us, r.big, r.x) for r in run_available(out, "held", str(tmp_path / "check")).collect() if r.stream_id < 2)
    assert got == [(0, 1, big, "nan"), (0, 2, None, "1.0"), (1, 1, big, "None")]


def test_long_stream_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 2).alias("stream_id"), F.col("id").alias("seq"), F.col("id").alias("at_us"), F.lit(3).cast("long").alias("service_us"))
        out = replay.replay(df, replay.busy_skip, "seq long, taken boolean", start=lambda: None).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.seq for r in out if r.taken) == [i for i in range(100) if i // 2 % 2 == 0]


def test_runs_between_idle_gaps_equal_the_whole_stream(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 2, 5, 40])
        rows.append((rng.choice([None, 1, 1, 1]), i, at, rng.randrange(0, 30), rng.random() < 0.2, None))
    df = spark.createDataFrame(rows, "stream_id long, seq long, at_us long, service_us long, failed boolean, x long").repartition(3)
    cases = [
        (replay.busy_skip, "seq long, taken boolean", F.col("at_us") + F.col("service_us"), lambda: None),
        (replay.back_off(25), "seq long, outcome string", F.when(F.col("failed"), F.col("at_us") + 25).otherwise(F.col("at_us")), lambda: (None, False)),
    ]
    for step, schema, ends, start in cases:
        whole = replay.replay(df, step, schema, start=start)
        cut = replay.replay_runs(df, step, schema, ends, start=start, slices=None)
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    # the longest part is a small share of the stream
    busy, longest, length = None, 0, 0
    for _, _, at, service, _, _ in (r for r in rows if r[0] == 1):
        length = 1 if busy is None or at >= busy else length + 1
        busy, longest = max(busy or 0, at + service), max(longest, length)
    assert longest < len(rows) // 50
