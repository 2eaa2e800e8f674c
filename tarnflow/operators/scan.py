"""Running values over an ordered stream as a parallel prefix scan: no task needs a whole stream.

A stream is cut into slices of its order.  Each slice is summed up on its own, the summaries (one row
a slice) are run through in order, and each slice starts from what comes before it.  That works for
any associative function.  Spark deals the rows by (stream, slice), so one stream may have all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice where none is given and the order is a number: rows, if that numbers the rows.
SLICE = 65_536


@dataclass(frozen=True)
class Running:
    """An associative function of ordered rows.

    ``value`` is what a row adds, null for nothing; ``own`` is the function over a window of rows;
    ``whole`` the same over a slice, given the value and the order; ``carry`` the function over a
    window of summaries; ``join`` puts what comes before a slice and what is in it together.
    """

    value: Column
    own: Callable[[Column], Column]
    whole: Callable[[Column, Column], Column]
    carry: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


def count(condition: Column | None = None) -> Running:
    """How many rows, or how many of them meet a condition."""
    one = F.lit(1).cast("long") if condition is None else F.when(condition, F.lit(1).cast("long"))
    return Running(one, F.count, lambda v, _: F.count(v), F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own)


def total(value: Column) -> Running:
    """The sum; null before the first value."""
    return Running(value, F.sum, lambda v, _: F.sum(v), F.sum, lambda before, own: F.coalesce(before + own, before, own))


def top(value: Column) -> Running:
    """The largest value."""
    return Running(value, F.max, lambda v, _: F.max(v), F.max, F.greatest)


def bottom(value: Column) -> Running:
    """The smallest value."""
    return Running(value, F.min, lambda v, _: F.min(v), F.min, F.least)


def last(value: Column, given: Column) -> Running:
    """The value, null or not, of the last row where ``given``; as a struct with the field ``v``, null if there is none."""
    seen = lambda c: F.last(c, ignorenulls=True)
    held = F.when(given, F.struct(value.alias("v")))
    return Running(held, seen, lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), seen, lambda before, own: F.coalesce(own, before))


def first(value: Column, given: Column) -> Running:
    """The value of the first row where ``given``, as a struct with the field ``v``."""
    seen = lambda c: F.first(c, ignorenulls=True)
    held = F.when(given, F.struct(value.alias("v")))
    return Running(held, seen, lambda v, at: F.min_by(v, F.when(v.isNotNull(), at)), seen, lambda before, own: F.coalesce(before, own))


def scan(
    df: DataFrame,
    functions: Mapping[str, Running],
    *,
    keys: tuple[str, ...] = ("stream_id",),
    order: tuple[str, ...] = ("seq",),
    slices: Column | str | None = None,
    own: bool = True,
) -> DataFrame:
    """``df`` with a column for each of ``functions``: its value over a key's rows up to each row, or before it (``own=False``).

    The result is that of a window over the whole key, nulls first; the order of equal rows is any,
    but one of a key and slice is that of all functions.  ``slices`` is a column that never falls
    along the order; by default slices are ``SLICE`` wide in the first column of the order, a number.
    Null keys are a key.  A slice should fit a task; a key may have as many as there are.
    """
    at = F.floor(F.col(order[0]) / SLICE) if slices is None else F.col(slices) if isinstance(slices, str) else slices
    names = {n: (f"__v{i}", f"__c{i}") for i, n in enumerate(functions)}
    rows = df.withColumns({"__slice": at, **{names[n][0]: f.value for n, f in functions.items()}})
    place = F.struct(*order)
    parts = rows.groupBy(*keys, "__slice").agg(*(f.whole(F.col(names[n][0]), place).alias(names[n][1]) for n, f in functions.items()))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(*keys, "__slice", *(f.carry(F.col(names[n][1])).over(before).alias(names[n][1]) for n, f in functions.items()))
    # what comes before a slice is its first row
    both = rows.withColumn("__row", F.lit(True)).unionByName(carries.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__slice").orderBy("__row", *order)
    upto, told = w.rowsBetween(Window.unboundedPreceding, 0 if own else -1), w.rowsBetween(Window.unboundedPreceding, 0)
    found = {n: f.join(F.first(names[n][1]).over(told), f.own(F.col(names[n][0])).over(upto)) for n, f in functions.items()}
    out = both.withColumns({f"__f{i}": c for i, c in enumerate(found.values())}).where("__row")
    kept = [F.col(c) for c in df.columns if c not in functions]
    return out.select(*kept, *(F.col(f"__f{i}").alias(n) for i, n in enumerate(functions)))


def numbered(df: DataFrame, name: str, *, keys: tuple[str, ...] = ("stream_id",), order: tuple[str, ...] = ("seq",), slices: Column | str | None = None) -> DataFrame:
    """``df`` with each row's place in its key, from 0."""
    return scan(df, {name: count()}, keys=keys, order=order, slices=slices, own=False)


def trailing(
    df: DataFrame, functions: Mapping[str, Column], window: int, *, keys: tuple[str, ...] = ("stream_id",), at: str = "at_us", width: int | None = None
) -> DataFrame:
    """``df`` with each aggregate over ``(at - window, at]``, by slices of ``at`` that are ``width`` wide.

    A row is also given to the slices in whose windows it is seen from: one more at most, where a
    slice is as wide as a window (the default is the window or ``SLICE``, what is wider).  Rows
    without a time are seen by one another only.
    """
    width = width or max(window, SLICE)
    here, there = F.floor(F.col(at) / width), F.floor((F.col(at) + (window - 1)) / width)
    rows = df.withColumns({"__home": here, "__slices": F.sequence(here, there)}).withColumn("__slice", F.explode_outer("__slices"))
    w = Window.partitionBy(*keys, "__slice").orderBy(at).rangeBetween(-(window - 1), 0)
    out = rows.withColumns({f"__f{i}": c.over(w) for i, c in enumerate(functions.values())}).where(F.col("__slice").eqNullSafe(F.col("__home")))
    kept = [F.col(c) for c in df.columns if c not in functions]
    return out.select(*kept, *(F.col(f"__f{i}").alias(n) for i, n in enumerate(functions)))
