"""Shingle sets of whole texts: keys under which all near sets meet, sketches that rule pairs out, exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import forget, meet, written
from tarnflow.llm.words import SPACES_LOWER, batches_of, column_bytes, rolling, word_hashes

SEED = 42
#: Least Jaccard similarity of near copies, as a fraction.
NEAR, OF = 4, 5
#: One document of so many is read to learn which shingles are common, how many of those share a common one, and how
#: many common ones are kept at most (32 MB), the commonest.  This orders keys and changes no result.
COMMON_SHARE, COMMON, COMMON_MOST = 4, 4, 4_000_000
#: Bits of the table of keys that are worth a shuffle (32 MB), and words of a parity sketch.
TABLE_BITS, SKETCH = 28, 8


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles, sorted; a text of fewer words is one shingle."""
    return [np.unique(rolling(h, min(width, max(1, len(h))))) for h in word_hashes(texts, SPACES_LOWER)]


def set_id(own: np.ndarray) -> int:
    """64 bits of a set of shingles, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(own.tobytes(), SEED), "big", signed=True)


def majority(own: np.ndarray) -> int:
    """SimHash of a set of hashes, signed: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(own, 1 + len(own) // 65_536):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of hashes of common shingles, sorted, and their ranks."""
    some = docs.where(F.pmod(F.xxhash64("k", "t"), F.lit(COMMON_SHARE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = np.concatenate(shingle_sets(column_bytes(batch.column("text")), shingle))
            key, count = np.unique(_half(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int32)), pa.array(count.astype(np.int32))], ["key", "n"])

    counts = some.select("text").mapInArrow(run, "key int, n int").groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= COMMON), "common")
    least = COMMON
    if counts.count() > COMMON_MOST:
        # the least number of documents that no more than so many shingles have
        sizes = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)
        least = int(sizes["n"][sizes["count"].cumsum() <= COMMON_MOST].min())
    got = counts.where(F.col("n") >= least).toArrow()
    key = got.column("key").to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(key)
    ranks = np.log2(np.maximum(got.column("n").to_numpy(), 1))[order].astype(np.uint8)
    forget(counts)
    return key[order], ranks


def _half(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def with_keys(docs: DataFrame, shingle: int) -> DataFrame:
    """``k`` and ``t`` of ``docs`` with the ``id`` of the text's shingle set, its size ``n``, its SimHash ``fp``, ``sketch`` and ``keys``.

    Of two sets of Jaccard similarity t or more, in any one order of all shingles, the first
    n - ceil(t n) + 1 shingles of each have one in common.  These are the keys, rare ones first.
    The sketch has parities of the shingles' numbers by hash: a bit that differs takes a shingle
    that only one set has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks = shared.value
        for batch in batches_of(batches):
            ids, sizes, prints, sketches, keys = [], [], [], [], []
            for own in shingle_sets(column_bytes(batch.column("text")), shingle):
                n = len(own)
                ids.append(set_id(own))
                sizes.append(n)
                prints.append(majority(own))
                parity = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketches.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                if n and len(common):
                    half = _half(own)
                    at = np.minimum(np.searchsorted(common, half), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == half, ranks[at] + 1, 0), kind="stable")]
                keys.append(own[: n + NEAR * n // -OF + 1 if n else 0])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = pa.array(np.concatenate(keys).view(np.int64))
            sketch = pa.ListArray.from_arrays(np.arange(0, SKETCH * len(ids) + 1, SKETCH, np.int32), pa.array(np.concatenate(sketches)))
            added = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), sketch, pa.ListArray.from_arrays(ends, values)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), *added], ["k", "t", "id", "n", "fp", "sketch", "keys"])

    return docs.select("k", "t", "text").mapInArrow(run, "k long, t long, id long, n int, fp long, sketch array<long>, keys array<long>")


def bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """A table of fixed size, packed: bit by bit, whether ``v`` has a value that ends so."""
    chunk = 15
    at = F.col("v").bitwiseAND((1 << bits) - 1)
    rows = values.select(F.shiftright(at, chunk).alias("chunk"), at.bitwiseAND((1 << chunk) - 1).alias("at"))
    rows = rows.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits"))
    table = np.zeros(1 << bits - 3, np.uint8)
    for row in rows.toLocalIterator():
        at = row.chunk << chunk - 3
        table[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)[: len(table) - at]
    return table


def _in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.int64(8 * len(table) - 1)
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def key_members(prints: DataFrame) -> DataFrame:
    """``key``, ``id``, ``n`` and ``lead``: the keys that several sets have, and of keys that the same sets have one.

    Of two near sets, the smaller has 8 ninths of its shingles in the other, so a shared key is among its
    first n - ceil(8 n / 9) + 1: these are its leading keys.
    Ends of keys are counted first: a key whose end comes once is one set's alone and is not sent.  Which
    sets have a key is told by their number and 128 bits of hashes, as sets are told by their ids.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("keys").flatten().to_numpy(zero_copy_only=False) & np.int64((1 << TABLE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32))], ["v"])

    counts = prints.select("keys").mapInArrow(ends, "v int").groupBy("v").count().where("count > 1")
    shared = prints.sparkSession.sparkContext.broadcast(bit_table(counts.select(F.col("v").cast("long").alias("v")), TABLE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            values = keys.flatten().to_numpy(zero_copy_only=False)
            sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            n = batch.column("n").to_numpy().astype(np.int64)
            lead = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= (n + 2 * NEAR * n // -(NEAR + OF))[row]
            some = _in_table(shared.value, values)
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[some]), batch.column("id").take(at), batch.column("n").take(at), pa.array(lead[some])], ["key", "id", "n", "lead"]
            )

    some = written(prints.select("id", "n", "keys").mapInArrow(run, "key long, id long, n int, lead boolean").distinct(), "some")
    shared.destroy()
    has = [F.count("*").alias("has"), F.bit_xor(F.xxhash64("id", "lead")).alias("one"), F.bit_xor(F.xxhash64("lead", "id", F.lit(1))).alias("other")]
    kept = some.groupBy("key").agg(*has).where("has > 1").groupBy("has", "one", "other").agg(F.min("key").alias("key"))
    members = written(some.join(kept.select("key"), "key"), "members")
    forget(some)
    return members


def packed_texts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``id`` and ``z``, the words of a text in lower case, compressed, of a table of ``id``, ``k`` and ``t``.

    A text takes far less room so than the hashes of its shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches_of(batches):
            lean = [b" ".join(SPACES_LOWER.words(t)) for t in column_bytes(batch.column("text"))]
            packed = [len(t).to_bytes(8, "big") + codec.compress(t, asbytes=True) for t in lean]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "z"])

    found = meet(texts.select("k", "t", "text"), ids, ["k", "t"]).select("id", "text").mapInArrow(run, "id long, z binary")
    return found.groupBy("id").agg(F.first("z").alias("z"))


def _unpack(z: bytes, codec: pa.Codec) -> bytes:
    return codec.decompress(z[8:], decompressed_size=int.from_bytes(z[:8], "big"), asbytes=True) if len(z) > 8 else b""


def may_fit(n: str, sketch: str, other_n: str, other_sketch: str) -> Column:
    """Whether two sets' sizes and sketches do not show that they share fewer shingles than near sets share."""
    differ = sum((F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(other_sketch)[i])) for i in range(SKETCH)), F.lit(0))
    sizes = F.least(n, other_n) * OF >= F.greatest(n, other_n) * NEAR
    return sizes & (differ * (OF + NEAR) <= (F.col(n) + F.col(other_n)) * (OF - NEAR))


def may_be_near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of ids whose sets may be near by their sizes and sketches."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_s"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(may_fit("a_n", "a_s", "b_n", "b_s")).select("a", "b")


def similar(pairs: DataFrame, packed: DataFrame, shingle: int) -> DataFrame:
    """The pairs (``a``, ``b``) of ids whose shingle sets have a Jaccard similarity of ``NEAR / OF`` at least."""
    of = lambda end: packed.select(F.col("id").alias(end), F.col("z").alias(f"{end}_z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            near = []
            for a, b in zip(batch.column("a_z"), batch.column("b_z"), strict=True):
                one, other = shingle_sets([_unpack(a.as_py(), codec), _unpack(b.as_py(), codec)], shingle)
                both = len(np.intersect1d(one, other, assume_unique=True))
                near.append(both * OF >= (len(one) + len(other) - both) * NEAR)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_z", "b_z")
    return both.mapInArrow(run, "a long, b long")
