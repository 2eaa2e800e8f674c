"""The flagship query: a pipeline from source to report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import gating, metrics
from tarnflow.plans.pipeline import Apply, DropFrames, EveryNFrames, Pipeline
from tarnflow.plans.registry import query
from tarnflow.sources.tables import event_stream


@query(
    "flagship",
    """WITH {ev}, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS n FROM ev WHERE seq % 2 = 0),
       b AS (SELECT *, CASE WHEN n % 3 = 0 THEN value * 2 ELSE value END AS v FROM a),
       g AS (SELECT *, max(seq * 7 + k) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b)
       SELECT stream_id, seq, at_us, v AS value, round(avg(v) OVER (PARTITION BY stream_id ORDER BY at_us
         RANGE BETWEEN 359999999999 PRECEDING AND CURRENT ROW), 6) AS average
       FROM g WHERE top IS NULL OR seq * 7 + k > top""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row, every third of those doubled, times made monotonic, trailing means."""
    gate = Apply(lambda df: gating.monotonic_gate(df, F.col("seq") * 7 + F.col("k"), slices="slice"))
    means = Apply(lambda df: metrics.trailing_average(df, "average", F.col("value"), 360_000_000_000).withColumn("average", F.round("average", 6)))
    pipeline = (
        Pipeline("flagship")
        .step(DropFrames(2))
        .step(EveryNFrames({"value": "value * 2"}, interval_frames=3))
        .step(gate)
        .step(means)
    )
    return pipeline.run(event_stream(spark, sf_dir)).select("stream_id", "seq", "at_us", "value", "average")
