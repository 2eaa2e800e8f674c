"""Packet sources: what is let in, and where a connection begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.scan import count, last, scan


def packet_source(packets: DataFrame, size: str = "size") -> DataFrame:
    """Packets that carry data; a null size carries none."""
    return packets.where(F.col(size) > 0)


def valid_stream(codec: Column, width: Column, height: Column, index: Column, rate: Column, base: Column) -> Column:
    """Whether a stream's metadata can be used: a codec's name, positive sizes, rates positive or unknown."""
    named = F.length(F.trim(codec)) > 0
    whole = (width > 0) & (height > 0) & (index >= 0)
    rates = (rate.isNull() | (rate > 0)) & (base.isNull() | (base > 0))
    return F.coalesce(named & whole & rates, F.lit(False))


def generations(df: DataFrame, name: str, resets: Column, *, stream: str = "stream_id", order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with the number of the connection, which a row with ``resets`` begins."""
    return scan(df, {name: count(resets)}, keys=(stream,), order=(order,), slices=slices)


def key_generations(df: DataFrame, name: str, *key: str, stream: str = "stream_id", order: str = "seq", slices: str | None = None) -> DataFrame:
    """``df`` with the number of the output, which begins anew where the key changes; null equals null."""
    how = {"keys": (stream,), "order": (order,), "slices": slices}
    rows = scan(df.withColumn("__key", F.struct(*key)), {"__before": last(F.col("__key"), F.lit(True))}, **how, own=False)
    changed = F.col("__before").isNotNull() & ~F.col("__before.v").eqNullSafe(F.col("__key"))
    return scan(rows, {name: count(changed)}, **how).drop("__key", "__before")


def connect(
    packets: DataFrame, begins: Column, metadata: Column, usable: Column, *, size: str = "size", stream: str = "stream_id", order: str = "seq", slices: str | None = None
) -> DataFrame:
    """Packets with data, their ``connection`` and its ``metadata``, which all packets of a connection share.

    A row with ``begins`` opens a connection; if its metadata are not ``usable`` the connection gives
    nothing, and neither do rows before the first.
    """
    opened = last(F.struct(metadata.alias("metadata"), usable.alias("usable")), F.coalesce(begins, F.lit(False)))
    rows = scan(packets, {"connection": count(begins), "__last": opened}, keys=(stream,), order=(order,), slices=slices)
    return packet_source(rows.where("__last.v.usable"), size).withColumn("metadata", F.col("__last.v.metadata")).drop("__last")
