"""Settings that change between micro-batches, and reports that slide over a stream."""

import time

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import metrics
from tarnflow.plans.pipeline import DropFrames, EveryNFrames, Pipeline
from tarnflow.sources.tables import event_stream
from tarnflow.streaming.settings import Revisions, run_live
from tarnflow.streaming.timers import sliding_report, trailing_stream

ROWS = "stream_id long, seq long, value long"


@pytest.fixture(autouse=True)
def own_store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_takes_a_new_interval_between_micro_batches(spark, tmp_path):
    text, failing = ["EveryNFrames:\n  interval_frames: 2"], [True]
    pipeline = Pipeline("live").step(EveryNFrames({"value": "value + 100"}, index="seq")).step(DropFrames(1, index="seq"))
    add = lambda a, b: spark.createDataFrame([(0, i, i) for i in range(a, b)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def sink(rows, batch):
        rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{batch}"))
        if batch == 1 and failing[0]:
            # the rows are there, but the batch counts as not done, and meanwhile the file changes
            failing[0] = False
            text[0] = "EveryNFrames:\n  interval_frames: 4"
            raise RuntimeError("lost")

    def run():
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run_live(source, pipeline, lambda: text[0], str(tmp_path / "revisions"), sink, poll_s=0).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    def rows(batch):
        found = spark.read.parquet(str(tmp_path / f"out/{batch}")).collect()
        return {r.seq: r.value for r in found}, {r.revision for r in found}

    want = lambda a, b, n: {i: i + 100 if i % n == 0 else i for i in range(a, b)}
    add(0, 7)
    run()
    assert rows(0) == (want(0, 7, 2), {0})
    text[0] = "EveryNFrames:\n  interval_frames: 3"
    add(7, 14)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    # tried again, the batch has the interval that it had, not the one of now; places go on over micro-batches
    assert rows(1) == (want(7, 14, 3), {1})
    add(14, 21)
    run()
    assert rows(2) == (want(14, 21, 4), {2})
    for wrong in ("EveryNFrames:\n  interval_frames: 0", "EveryNFrames:\n  other: 1", "nonsense: ["):
        text[0] = wrong
        time.sleep(0.01)
        add(21, 25)
        run()
    assert rows(5) == (want(21, 25, 4), {2})


def test_a_new_run_goes_on_with_the_last_settings(spark, tmp_path):
    log = Revisions(spark, str(tmp_path / "r"), keep=2)
    for batch in range(4):
        log.put(batch, batch, {"A": {"x": batch}})
    assert log.get(3) == (3, {"A": {"x": 3}}) and log.get(0) is None and log.get(9) is None


def live(spark, tmp_path, rows, cut):
    """``rows`` in two files by time, and a last row of another stream, far on, that moves the watermark."""
    end = rows.agg(F.max("at_us")).first()[0]
    rows = rows.withColumn("ts", F.timestamp_micros("at_us"))
    rows.where(F.col("at_us") < cut).coalesce(1).write.parquet(str(tmp_path / "in"))
    time.sleep(0.05)
    last = spark.createDataFrame([(-1, 0, end + 10**14, 0.0)], "stream_id long, seq long, at_us long, value double").withColumn("ts", F.timestamp_micros("at_us"))
    rows.where(F.col("at_us") >= cut).unionByName(last).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def output(df, tmp_path):
    df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / "out")).where("stream_id >= 0")


def some_events(spark):
    rows = event_stream(spark, "/root/testdata/sf0.001").where("stream_id < 6").select("stream_id", "seq", "at_us", "value")
    return rows, sorted(r.at_us for r in rows.collect())[20]


def test_trailing_means_of_a_stream_equal_the_batch(spark, tmp_path):
    rows, cut = some_events(spark)
    window = 240 * 3_600_000_000
    got = output(trailing_stream(live(spark, tmp_path, rows, cut), window), tmp_path)
    want = metrics.trailing_average(rows, "average", F.col("value"), window)
    near = lambda df: sorted((r.stream_id, r.seq, round(r.average, 6)) for r in df.collect())
    assert near(got) == near(want)


def test_sliding_reports_from_panes(spark, tmp_path):
    rows, cut = some_events(spark)
    day = 86_400_000_000
    got = output(sliding_report(live(spark, tmp_path, rows, cut), day, 5 * day), tmp_path).collect()
    given: dict[int, list] = {}
    for r in rows.collect():
        given.setdefault(r.stream_id, []).append((r.at_us, r.value))
    want = {}
    for stream, own in given.items():
        ends = [-(-at // day) for at, _ in own]
        for end in range(min(ends), max(ends) + 1):
            inside = lambda width: [v for at, v in own if (end - width) * day < at <= end * day]  # noqa: B023, E731
            one, five = inside(1), inside(5)
            want[stream, end * day] = (len(one), round(sum(one) / len(one), 6) if one else 0.0, round(sum(five) / len(five), 6) if five else None)
    assert any(n == 0 for n, _, _ in want.values()) and any(r is None for *_, r in want.values()) or len(want) > 50
    assert {(r.stream_id, r.end_us): (r.frames, round(r["mean"], 6), None if r.recent is None else round(r.recent, 6)) for r in got} == want
    with pytest.raises(ValueError):
        sliding_report(rows.withColumn("ts", F.timestamp_micros("at_us")), 2000, 3000)
