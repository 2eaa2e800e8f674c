"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import fresh

#: Shards and (prime) slots of the registered query.
SHARDS, SLOTS = 64, 8191
#: Largest table that is sent to every executor.
MAX_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int) -> list[int]:
    """Shard index of each slot.

    A shard's preference order is a walk through all slots: from an offset, by a step, both taken
    from its name.  Shards take turns; in its turn a shard claims the next free slot it prefers.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, one at least")
    if not _prime(slots) or not len(names) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.md5(x.encode()).digest() for x in names]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(names)):
            if not free:
                break
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            free -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the md5 of its text; a null key is an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def assign_shards(
    docs: DataFrame, *, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS
) -> DataFrame:
    """Every row of ``docs`` with ``slot`` and ``shard``; equal keys meet in one shard.

    The table has ``slots`` rows whatever the input, so it is broadcast.  Null keys share the slot
    of the empty text.  An empty table gives an empty table.  A clashing column name is prefixed
    with ``_``.
    """
    spark: SparkSession = docs.sparkSession
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    slot, shard, at = fresh(docs, "slot", "shard", "at")
    rows = list(enumerate(lookup_table(names, slots)))
    table = spark.createDataFrame(rows, f"`{at}` long, `{shard}` int")
    docs = docs.withColumn(slot, slot_of(F.col(key), slots))
    return docs.join(F.broadcast(table), F.col(slot) == F.col(at)).drop(at)


def write_shards(sharded: DataFrame, path: str, *, shard: str = "shard", files: int = 1) -> None:
    """Parquet files under ``path``, one folder per shard; ``files`` tasks share a shard's rows.

    Rows are dealt by all their columns, nulls included, so a hot key is not one task's; equal rows meet
    in one file.  An empty table writes no shard.
    """
    parts = F.pmod(F.xxhash64(*[F.col(c) for c in sharded.columns]), F.lit(files))
    sharded.repartition(F.col(shard), parts).write.partitionBy(shard).parquet(path)
