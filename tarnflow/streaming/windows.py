"""Windowed reports over a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_report(df: DataFrame, interval: str, late: str, *, at: str = "ts", value: str = "value") -> DataFrame:
    """Rows and mean value per interval; an interval is final once the watermark has passed it."""
    return (
        df.withWatermark(at, late)
        .groupBy(F.window(at, interval).alias("w"))
        .agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
        .select(F.col("w.start").alias("start"), "n", "mean")
    )


def sessions(df: DataFrame, gap: str, late: str, *, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs of rows of a key with silences shorter than ``gap``."""
    w = F.session_window(at, gap).alias("w")
    return df.withWatermark(at, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
