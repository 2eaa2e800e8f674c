"""A report beside a running query: metrics that are read off as batches end, rows pass untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, seconds: Column) -> DataFrame:
    """``df``; rows, their time and their slowest are counted under ``name`` as they pass."""
    return df.observe(name, F.count("*").alias("frames"), F.sum(F.greatest(seconds, F.lit(0.0))).alias("seconds"), F.max(seconds).alias("slowest"))


class Report(StreamingQueryListener):
    """Keeps the metrics of each micro-batch: frames a second, and mean milliseconds, 0 without frames."""

    def __init__(self, name: str) -> None:
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        elapsed = event.progress.batchDuration / 1000
        mean = 1000 * found["seconds"] / found["frames"] if found["frames"] else 0.0
        self.rows.append({"frames": found["frames"], "fps": found["frames"] / elapsed if elapsed else 0.0, "avg_ms": mean})
