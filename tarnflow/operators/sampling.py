"""Sampling and conditional sub-pipelines over an ordered stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.scan import numbered


def _positive(n: object, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{name} must be a positive integer")
    return n


def drop_frames(df: DataFrame, keep_every: int = 1, *, stream: str = "stream_id", order: str = "seq", slices: str | None = None) -> DataFrame:
    """Rows at every ``keep_every``-th place, from the first."""
    _positive(keep_every, "keep_every")
    at = "__at"
    return numbered(df, at, keys=(stream,), order=(order,), slices=slices).where(F.col(at) % keep_every == 0).drop(at)


def every_n(
    df: DataFrame,
    changes: Mapping[str, Column],
    interval: int | Column = 1,
    *,
    stream: str = "stream_id",
    order: str = "seq",
    slices: str | None = None,
) -> DataFrame:
    """``changes`` at every ``interval``-th place; other rows pass.  The place counts all rows, even
    where a live interval changes."""
    n = interval if isinstance(interval, Column) else F.lit(_positive(interval, "interval"))
    rows = numbered(df, "__at", keys=(stream,), order=(order,), slices=slices)
    hit = F.col("__at") % n == 0
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__at")


def chain_until_failure(steps: list[Callable[[Column], Column]], failed: list[Column], value: Column) -> Column:
    """Value after the steps before the first that failed: an inner chain keeps its finished part."""
    out, alive = value, F.lit(True)
    for step, broken in zip(steps, failed, strict=True):
        alive = alive & ~broken
        out = F.when(alive, step(out)).otherwise(out)
    return out


def chain_with_drops(steps: list[Callable[[Column], Column]], drops: list[Callable[[Column], Column]], value: Column) -> tuple[Column, Column]:
    """Value after an inner chain, and whether a step dropped the row; ``drops`` tell so of each step's
    result.  Steps after a drop do not see the row."""
    out, gone = value, F.lit(False)
    for step, drop in zip(steps, drops, strict=True):
        out = F.when(~gone, step(out)).otherwise(out)
        gone = gone | F.coalesce(F.when(~gone, drop(out)), F.lit(False))
    return out, gone


def run_once(df: DataFrame, changes: Mapping[str, Column], *, fails: Column | None = None, stream: str = "stream_id", order: str = "seq") -> DataFrame:
    """``changes`` at the first row on which the step does not fail; others pass."""
    works = F.lit(True) if fails is None else ~fails
    w = Window.partitionBy(stream)
    first = F.min(F.when(works, F.col(order))).over(w)
    return df.withColumns({c: F.when(F.col(order) == first, v).otherwise(F.col(c)) for c, v in changes.items()})


def run_once_many(df: DataFrame, outputs: Column, name: str, *, stream: str = "stream_id", order: str = "seq") -> DataFrame:
    """The first row gives a row for each of ``outputs``, none if there are none; others give one with null."""
    kind = df.select(outputs.alias("x")).schema["x"].dataType
    one = F.array(F.lit(None).cast(kind.elementType))
    at = "__at"
    rows = numbered(df, at, keys=(stream,), order=(order,))
    return rows.withColumn(name, F.explode(F.when(F.col(at) == 0, outputs).otherwise(one))).drop(at)
