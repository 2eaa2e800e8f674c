"""State machines in Structured Streaming: the same ``step`` as in a batch, state in the state store."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnflow.operators.replay import Finish, Step


def _exact(column: Column, kind: T.DataType) -> tuple[Column, Callable[[Any], Any]]:
    """A column as one that pandas does not round and in which it tells null from NaN, and the way back."""
    if isinstance(kind, T.IntegralType):
        return column.cast("decimal(20,0)"), lambda x: None if x is None else int(x)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return column.cast("string"), lambda x: None if x is None else float(x.replace("Infinity", "inf"))
    if isinstance(kind, T.TimestampType):
        first = datetime(1970, 1, 1, tzinfo=UTC)
        return F.unix_micros(column).cast("decimal(20,0)"), lambda x: None if x is None else first + timedelta(microseconds=int(x))
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("string"), lambda x: None if x is None else datetime.fromisoformat(x)
    return column, lambda x: x


def replay_stream(
    df: DataFrame,
    step: Step,
    schema: str,
    *,
    start: Callable[[], Any],
    stream: str = "stream_id",
    order: tuple[str, ...] = ("at_us",),
    finish: Finish | None = None,
    at: str | None = None,
    idle_ms: int = 60_000,
) -> DataFrame:
    """``tarnflow.operators.replay.replay`` over a stream.

    Rows of a micro-batch are sorted within their stream (nulls first) before they are stepped through,
    so the source has to deliver micro-batches in order.  All rows of a stream in a micro-batch are
    gathered first: they come unordered.  Whole numbers, nulls and NaN stay what they are.

    A stream has no last row, so ``finish`` needs ``at``, a timestamp column: a stream ends once the
    watermark, the newest time of all, has passed its last row by ``idle_ms``.  Later rows begin it anew.
    """
    if finish is not None and at is None:
        raise ValueError("finish needs a column of event times")
    out = T.StructType([df.schema[stream], *T.StructType.fromDDL(schema).fields])
    names, timeout = df.columns, GroupStateTimeout.NoTimeout
    if at is not None:
        df, timeout = df.withWatermark(at, "0 seconds"), GroupStateTimeout.EventTimeTimeout
        df = df.withColumn("ms", (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long"))
    there = {f.name: _exact(F.col(f.name), f.dataType) for f in df.schema.fields}
    back = {c: f for c, (_, f) in there.items()}
    kept = [F.col(stream), *([F.col(at)] if at not in (None, stream) else [])]
    packed = df.select(*kept, *[c.alias(f"__{n}") for n, (c, _) in there.items()])
    rank = lambda row: tuple((row[c] is not None, row[c]) for c in order)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows, strict=True)) or [()] * len(out.names)
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(out.names, columns, strict=True)})

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start()
        if state.hasTimedOut:
            state.remove()
            yield frame([(*key, *x) for x in finish(now)] if finish else [])
            return
        rows = [dict(zip(back, row, strict=True)) for part in parts for row in zip(*(map(f, part[f"__{c}"].tolist()) for c, f in back.items()), strict=True)]
        made = []
        for row in sorted(rows, key=rank):
            now, found = step(now, {c: row[c] for c in names})
            made += [(*key, *x) for x in found]
        state.update((pickle.dumps(now),))
        if finish is not None:
            newest = max((r["ms"] for r in rows if r["ms"] is not None), default=0)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield frame(made)

    return packed.groupBy(stream).applyInPandasWithState(run, out, "state binary", "append", timeout)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, through the stream, into a table in memory: for tests and small reports."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    return df.sparkSession.table(name)
