"""Prefix scans over slices against windows over whole streams, and where the rows of one stream go."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnflow.operators import gating, metrics, sampling, scan
from tarnflow.sources.tables import event_stream

SCHEMA = "stream_id long, seq long, v long, d double, g boolean"


def rows_of(seed, n=400, streams=(None, 1, 2, 3)):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.2 else x
    return [(r.choice(streams), some(i) if i % 17 == 0 else i, some(r.randrange(-50, 50)), some(r.randrange(100) / 4), some(r.random() < 0.3)) for i in r.sample(range(n), n)]


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_every_function_equals_its_window(spark, own, width):
    df = spark.createDataFrame(rows_of(width), SCHEMA).repartition(5)
    given = F.coalesce("g", F.lit(False))
    functions = {
        "n": scan.count(), "hits": scan.count(F.col("g")), "sum": scan.total(F.col("d")), "top": scan.top(F.col("v")), "low": scan.bottom(F.col("v")),
        "pair": scan.top(F.struct("d", "v")), "last": scan.last(F.col("v"), given), "first": scan.first(F.col("v"), given),
    }
    w = Window.partitionBy("stream_id").orderBy("seq", "v", "d").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    held = F.when(given, F.struct(F.col("v").alias("v")))
    windows = {
        "n": F.count(F.lit(1)).over(w), "hits": F.count(F.when(F.col("g"), 1)).over(w), "sum": F.sum("d").over(w), "top": F.max("v").over(w), "low": F.min("v").over(w),
        "pair": F.max(F.struct("d", "v")).over(w), "last": F.last(held, True).over(w), "first": F.first(held, True).over(w),
    }
    got = scan.scan(df, functions, order=("seq", "v", "d"), slices=F.floor(F.col("seq") / width), own=own)
    assert got.columns == [*df.columns, *functions]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumns(windows).collect()))


def test_scan_of_nothing_and_of_a_named_column(spark):
    df = spark.createDataFrame(rows_of(1), SCHEMA)
    assert scan.scan(df.limit(0), {"n": scan.count()}).count() == 0
    # a column of the result's name gives way
    assert scan.numbered(df, "v").agg(F.max("v")).first()[0] < len(rows_of(1))


@pytest.mark.parametrize("width", [10, 25, 1000])
def test_trailing_equals_its_window(spark, width):
    df = spark.createDataFrame(rows_of(3), SCHEMA)
    w = Window.partitionBy("stream_id").orderBy("seq").rangeBetween(-9, 0)
    want = df.withColumns({"m": F.avg("v").over(w), "n": F.count("v").over(w)})
    got = scan.trailing(df, {"m": F.avg("v"), "n": F.count("v")}, 10, at="seq", width=width)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_stream_of_all_rows_is_in_no_task(spark):
    """Every operator that follows a stream's order, over one stream that has all rows."""
    n, width = 4000, 250
    df = spark.range(n).select(F.lit(7).cast("long").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") * 13 % 101).alias("v"), (F.col("id") * 1000).alias("at_us"), F.floor(F.col("id") / width).alias("slice"))
    keep, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(keep, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = {
            "drop_frames": sampling.drop_frames(df, 2, slices="slice"),
            "every_n": sampling.every_n(df, {"v": F.col("v") + 1}, 3, slices="slice"),
            "gate": gating.monotonic_gate(df, F.col("seq"), slices="slice"),
            "resets": gating.monotonic_gate(df, F.col("seq"), resets=F.col("v") < 0, slices="slice"),
            "carry": gating.carry_forward(df, "c", F.col("v"), F.col("v") % 7 == 0, F.col("v") % 11 == 0, keys=("stream_id",), slices="slice"),
            "keyframes": gating.keyframe_gate(df, F.col("v") % 50 == 0, F.col("v") % 31 == 0, F.col("v") % 3 > 0, slices="slice"),
            "counters": metrics.counters(df, F.col("v"), slices="slice"),
            "trailing": metrics.trailing_average(df, "m", F.col("v"), 10_000, width_us=250_000),
        }
        for name, out in found.items():
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) >= n // 2 and max(sizes) < n // 3, name
    finally:
        spark.conf.unset(keep)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_of_events_by_slices(spark):
    whole = event_stream(spark, "/root/testdata/sf0.001", 10**18).select("event_id", "seq").collect()
    cut = event_stream(spark, "/root/testdata/sf0.001", 86_400_000_000).select("event_id", "seq").collect()
    assert sorted(whole) == sorted(cut)
