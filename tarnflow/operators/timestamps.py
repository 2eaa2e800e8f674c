"""Timestamps as whole numbers of a rational base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.scan import count, first, numbered, scan


def rescale(pts: Column, num: Column, den: Column, to_num: Column | int, to_den: Column | int) -> Column:
    """``pts`` in another base, to the nearest whole number, halves to even.

    Exact: the whole part and what is left of it are whole numbers of up to 38 digits.  Null for a base
    of 0 or less on either side, and where a product or the result has no room.
    """
    to = [F.lit(x) if isinstance(x, int) else x for x in (to_num, to_den)]
    wide = [c.cast("decimal(19,0)") for c in (num, den, *to)]
    # what cannot be multiplied exactly is null, not rounded
    top = F.try_multiply(F.try_multiply(wide[0], wide[3]).try_cast("decimal(38,0)"), pts.cast("decimal(19,0)")).try_cast("decimal(38,0)")
    low = F.try_multiply(wide[1], wide[2]).try_cast("decimal(38,0)")
    rest = F.pmod(top, low)
    whole = F.try_divide(top - rest, low).try_cast("decimal(38,0)")
    # twice the rest may have no room, so the rest is held against what is missing
    above = low - rest
    up = (rest > above) | ((rest == above) & (F.pmod(whole, F.lit(2)) == 1))
    known = (num > 0) & (den > 0) & (to[0] > 0) & (to[1] > 0)
    return F.when(known, (whole + F.when(up, 1).otherwise(0)).try_cast("long"))


def session_base(df: DataFrame, name: str, num: Column, den: Column, *, keys: tuple[str, ...] = ("stream_id",), order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with the base (num, den) of a session: that of its first packet whose base is positive."""
    base = first(F.struct(num.alias("num"), den.alias("den")), F.coalesce((num > 0) & (den > 0), F.lit(False)))
    rows = scan(df, {"__base": base}, keys=keys, order=(order,), slices=slices)
    return rows.withColumn(name, F.col("__base.v")).drop("__base")


def fill_dts(dts: Column, pts: Column) -> Column:
    """A missing decoding time is the presentation time."""
    return F.coalesce(dts, pts)


def time_base(packet: Column, stream: Column, output: Column) -> Column:
    """The first base that is known."""
    return F.coalesce(packet, stream, output)


def generated(df: DataFrame, name: str, *order: str, stream: str = "stream_id", slices: str | None = None) -> DataFrame:
    """``df`` with times that count output packets, from 0; they go on over a new encoder."""
    return numbered(df, name, keys=(stream,), order=order, slices=slices)


def valid_time(pts: Column, num: Column, den: Column, duration: Column) -> Column:
    """Whether a frame's time can be preserved."""
    return F.coalesce(pts.isNotNull() & (num > 0) & (den > 0) & (F.coalesce(duration, F.lit(0)) >= 0), F.lit(False))


def preserve(frames: DataFrame, packets: DataFrame, valid: Column, *, keys: tuple[str, ...] = ("stream_id",), order: str = "seq") -> DataFrame:
    """Output packets in order take the times of valid frames in order; packets in excess go.

    After a failure nothing waits any more: pairs are made within ``keys``, which have the number of
    failures so far (``failures``) where a codec may fail.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    left = frames.where(valid).withColumn("__n", F.row_number().over(w))
    right = packets.withColumn("__n", F.row_number().over(w)).drop(order)
    return left.join(right, [*keys, "__n"]).drop("__n")


def failures(df: DataFrame, name: str, failed: Column, *, stream: str = "stream_id", order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with how often the codec has failed up to a row, and at it."""
    return scan(df, {name: count(failed)}, keys=(stream,), order=(order,), slices=slices)
