"""Tables as ordered streams and as tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.scan import numbered

#: Width of the slices of a stream's time in which its rows are numbered: so wide that a task holds the rows of one.
SLICE_US = 10 * 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str, slice_us: int = SLICE_US) -> DataFrame:
    """``events`` in order: stream_id, seq (from 0), at_us, event_type, value, k, service_us, and the slice of time.

    A service of ``value`` hours stands for one of as many time units.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"),
        "event_id",
        at.alias("at_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 3_600_000_000).cast("long").alias("service_us"),
        F.floor(at / slice_us).alias("slice"),
    )
    return numbered(rows, "seq", order=("at_us", "event_id"), slices="slice")


def live_events(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The event files as a streaming DataFrame."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.option("maxFilesPerTrigger", per_trigger).parquet(sf_dir)


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as model outputs: vec_id, and the vector in doubles."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
