"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.shared import NULL_ID, fresh, written
from tarnflow.llm.shingles import bit_table
from tarnflow.llm.words import ALNUM_LOWER, batches_of, column_bytes, mix, rolling, word_hashes

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of a benchmark whose tables are sent to the executors whole.
BLOCK_BYTES = 1 << 20
#: Bits of the table of suffixes of a larger benchmark: 2**28 bits, 32 MB.
SUFFIX_BITS = 28
#: Entries of a shift table; a block of words picks one by its hash.
TABLE_BITS = 20


class WindowIndex:
    """Tables for all windows of one length.

    A block is the hash of ``block`` consecutive words.  ``shift`` says how far the window may move
    when the block at its end picks that entry: 0 where some test window ends in such a block.
    Blocks that pick one entry take the least shift, which is safe.  ``buckets`` holds, by the block
    at their end, the test windows to compare: their words' hashes, their words, their items.
    """

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length, self.block = length, min(3, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        self.buckets: dict[int, list[tuple[tuple[int, ...], tuple[bytes, ...], list[str]]]] = {}
        texts = list(windows)
        every = np.stack(word_hashes([b" ".join(w) for w in texts], ALNUM_LOWER))
        for end in range(self.block, length + 1):
            entry = self.entries(every[:, end - self.block : end].reshape(-1))[:: self.block]
            np.minimum.at(self.shift, entry, length - end)
        for bucket, hashes, words in zip(entry.tolist(), every.tolist(), texts, strict=True):
            self.buckets.setdefault(bucket, []).append((tuple(hashes), words, sorted(windows[words])))

    def entries(self, words: np.ndarray) -> np.ndarray:
        """Table entry of the block that starts at each word."""
        return (rolling(words, self.block) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, hashes: np.ndarray, words: Callable[[], list[bytes]]) -> Iterator[tuple[int, list[str]]]:
        """Starts of occurrences, with the items that have the window."""
        if len(hashes) < self.length:
            return
        entry = self.entries(hashes)
        moves = self.shift[entry].tobytes()
        at, last = self.length - self.block, len(moves)
        while at < last:
            move = moves[at]
            if move:
                at += move
                continue
            start = at + self.block - self.length
            end = start + self.length
            there = tuple(hashes[start:end].tolist())
            for known, window, items in self.buckets.get(int(entry[at]), ()):
                if known == there and window == tuple(words()[start:end]):
                    yield start, items
            at += 1


def build(items: list[tuple[str, bytes]], width: int) -> list[WindowIndex]:
    """An index for each length of window among the items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = ALNUM_LOWER.words(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
    return [WindowIndex(n, windows) for n, windows in sorted(by_length.items())]


def hits(hashes: np.ndarray, text: bytes, indexes: list[WindowIndex]) -> tuple[list[tuple[int, int]], list[str]]:
    """Word ranges that test windows cover, merged, and the items of those windows."""
    kept: list[list[bytes]] = []

    def words() -> list[bytes]:
        if not kept:
            kept.append(ALNUM_LOWER.words(text))
        return kept[0]

    found, items = [], set()
    for index in indexes:
        for start, names in index.search(hashes, words):
            found.append((start, start + index.length))
            items.update(names)
    spans: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    return spans, sorted(items)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _search(docs: DataFrame, text: str, items: list[tuple[str, bytes]], width: int, names: list[str]) -> DataFrame:
    """``docs`` with words, spans and items, for a benchmark that fits one block: nothing is shuffled."""
    n_words, spans, found = names
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, SPAN), T.StructField(found, T.ArrayType(T.StringType()))]
    )
    block = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = build(block.value, width)
        for batch in batches_of(batches, column=text):
            texts = column_bytes(batch.column(text))
            hashed = word_hashes(texts, ALNUM_LOWER)
            out = [hits(h, t, indexes) for h, t in zip(hashed, texts, strict=True)]
            added = [
                pa.array([len(h) for h in hashed], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in out], kind),
                pa.array([i for _, i in out], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _suffixes(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words: a hash of the block at its end, and one of the whole window."""
    block = min(3, length)
    ends = rolling(hashes, block)[length - block :]
    return mix(ends ^ np.uint64(length)), mix(rolling(hashes, length) ^ np.uint64(length))


def _windows(tests: DataFrame, width: int) -> DataFrame:
    """Every window of the benchmark: its length, hashes of its suffix and of itself, its words, its item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            texts = column_bytes(batch.column("text"))
            rows = []
            for item, text, hashes in zip(batch.column("item").to_pylist(), texts, word_hashes(texts, ALNUM_LOWER), strict=True):
                n = min(width, len(hashes))
                if n:
                    words = ALNUM_LOWER.words(text)
                    suffix, whole = (x.view(np.int64).tolist() for x in _suffixes(hashes, n))
                    rows += [(n, s, h, b" ".join(words[i : i + n]), item) for i, (s, h) in enumerate(zip(suffix, whole, strict=True))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "suffix", "hash", "words", "item"])

    return written(tests.mapInArrow(run, "n int, suffix long, hash long, words binary, item string").distinct(), "windows")


def _possible(narrow: DataFrame, text: str, lengths: list[int], table: np.ndarray) -> DataFrame:
    """Places of ``narrow`` (``k``, ``t``) whose suffix some window of the length may have, with their words."""
    shared = narrow.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column=text):
            texts, rows = column_bytes(batch.column(text)), []
            keys = zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True)
            for key, one, hashes in zip(keys, texts, word_hashes(texts, ALNUM_LOWER), strict=True):
                words: list[bytes] = []
                for n in lengths:
                    if len(hashes) < n:
                        continue
                    suffix, whole = _suffixes(hashes, n)
                    at = suffix.view(np.int64) & np.int64(8 * len(shared.value) - 1)
                    there = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    words = words or (ALNUM_LOWER.words(one) if len(there) else [])
                    rows += [(*key, i, n, h, b" ".join(words[i : i + n])) for i, h in zip(there.tolist(), whole[there].view(np.int64).tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k", "t", "start", "n", "hash", "words"])

    return narrow.mapInArrow(run, "k long, t long, start long, n int, hash long, words binary")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    table_bits: int = SUFFIX_BITS,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``spans`` (word ranges inside test windows) and ``items``.

    A benchmark of up to ``block_bytes`` is sent to the tasks, which search every text by its shift
    tables, and nothing is shuffled.  Of a larger one a table of its windows' suffixes is sent, which
    has ``2 ** table_bits`` bits whatever the benchmark; places whose suffix is in it meet the windows in buckets by a
    shuffle, and words are compared there.  So the corpus is read twice however long the benchmark is.

    Null texts have no words; items without words have no window; a null item id is an empty text.
    Items of equal text each count.  Rows with equal key and text are found alike.  Empty tables
    give no hits.  Of the added columns, a clashing name is prefixed with ``_``.
    """
    names = fresh(docs, "n_words", "spans", "items")
    tests = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    )
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= block_bytes:
        return _search(docs, text, [(r.item, r.text.encode()) for r in tests.collect()], width, names)
    windows = _windows(tests, width)
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    k, t = fresh(docs.select("*", *[F.lit(0).alias(n) for n in names]), "key", "text_hash")
    keyed = docs.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))).withColumn(t, F.xxhash64(text))
    narrow = keyed.select(F.col(k).alias("k"), F.col(t).alias("t"), F.col(text).alias("text"))
    places = _possible(narrow, "text", lengths, bit_table(windows.select(F.col("suffix").alias("v")), table_bits))
    found = places.join(windows.drop("suffix"), ["n", "hash", "words"]).select("k", "t", "start", (F.col("start") + F.col("n")).alias("end"), "item")
    merged = found.groupBy(F.col("k").alias(k), F.col("t").alias(t)).agg(
        merge_spans(F.collect_set(F.struct("start", "end"))).alias(names[1]), F.array_sort(F.collect_set("item")).alias(names[2])
    )
    counted = keyed.withColumn(names[0], F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long"))
    return (
        counted.join(merged, [k, t], "left")
        .withColumn(names[1], F.coalesce(names[1], F.array().cast(SPAN)))
        .withColumn(names[2], F.coalesce(names[2], F.array().cast("array<string>")))
        .drop(k, t)
    )


def merge_spans(spans: Column) -> Column:
    """Sorted, disjoint ranges that cover what ``spans`` cover."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = (F.size(done) > 0) & (x["start"] <= last["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), step)


def clean(found: DataFrame, spans: str = "spans") -> DataFrame:
    """The rows without a hit; repeated rows fare alike, null spans count as a hit.  An empty table gives an empty table."""
    return found.where(F.size(spans) == 0)
