"""Substring deduplication by a relative Lempel-Ziv parse.

The reference is the corpus itself, in global order (key, then start).  Documents are factored
against reference blocks that index windows of ``width`` words, the least length of a factor:

1. Each window has an anchor, the least hash of its 8-word grams; equal windows have equal anchors.
   How often anchors occur is counted over the whole corpus into a table of fixed size: a window
   whose anchor occurs once cannot occur twice.
2. A task gathers its documents as a reference block and factors them against it: a factor starts
   at a window that stands earlier too and goes on, word by word, as long as its source does.  Where
   it ends, the windows across its boundary are looked up anew, so none is lost between two factors.
3. Windows that stand first in their block are sent, as the words they cover, to index blocks dealt by
   anchor, where windows of all reference blocks meet and are factored in the same way.  Windows of
   very frequent anchors are dealt by the whole window, so no index block grows with one anchor.
4. A document's factors merge into the spans that go.

Hashes only find sources: words are numbered exactly within a block and every factor is compared
with its source word by word, so words go only where the words of an earlier window are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.shared import NULL_ID, fresh
from tarnflow.llm.words import SPACES, batches_of, column_bytes, mix, rolling, sliding, word_hashes, word_ids

#: Words of a window, and of the grams that stand for it.
WIDTH, GRAM = 20, 8
#: Bits of an anchor's number in the tables of anchors: two tables of 2**28 bits, 32 MB each.
TABLE_BITS = 28
#: Windows and bytes of text that a task gathers as its reference block, and windows that one index block should
#: get.  Index blocks are small enough for a document's windows to spread alike over few or many of them.
BLOCK_WINDOWS, BLOCK_BYTES, INDEX_WINDOWS = 500_000, 8 << 20, 200_000
#: Share of an index block above which an anchor is dealt by its whole windows.
HOT_SHARE = 20

_ROW = np.dtype([("doc", "<u4"), ("start", "<u4"), ("n", "<u4")])
#: Either documents, runs of their windows and the words of these, or one document and starts of windows that stand earlier too.
_SHIP = pa.schema([("index", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("starts", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.binary())])


def anchors(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window; the grams that are anchor of a window, each place once."""
    grams = rolling(words, gram)
    least = sliding(grams, width - gram + 1, np.minimum)
    if not len(least):
        return least, least
    pad = np.zeros(width - gram, np.uint64)
    chosen = grams[sliding(np.concatenate([pad, least, pad]), width - gram + 1, np.maximum) == grams]
    return least, chosen


def numbers(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The anchor's place in the table; mixed anew, for least hashes crowd at 0."""
    return (mix(anchor) >> np.uint64(64 - bits)).astype(np.int64)


def anchor_tables(texts: DataFrame, width: int, gram: int, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which anchors occur twice or more, which more than ``hot`` times, both packed; how many places anchors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = [anchors(w, width, gram)[1] for w in word_hashes(column_bytes(batch.column("text")), SPACES)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers(np.concatenate(found), bits))], ["n"])

    counts = texts.select("text").mapInArrow(run, "n long").groupBy("n").agg(F.count("*").alias("c"))
    chunk = 15
    at = F.col("n").bitwiseAND((1 << chunk) - 1)
    rows = (
        counts.groupBy(F.shiftright("n", chunk).alias("chunk"))
        .agg(
            F.sum("c").alias("c"),
            F.bitmap_construct_agg(F.when(F.col("c") > 1, at)).alias("twice"),
            F.bitmap_construct_agg(F.when(F.col("c") > hot, at)).alias("hot"),
        )
        .collect()
    )
    tables = np.zeros((2, 1 << bits - 3), np.uint8)
    for row in rows:
        start = row.chunk << chunk - 3
        for table, found in zip(tables, (row.twice, row.hot), strict=True):
            part = np.frombuffer(found, np.uint8)
            table[start : start + len(part)] = part[: len(table) - start]
    return tables[0], tables[1], sum(row.c for row in rows)


def _bit(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (table[n >> 3] >> (n & 7).astype(np.uint8) & 1).astype(bool)


def sources(ids: np.ndarray, at: np.ndarray, rank: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """For each window the place in ``at`` of the first one of the same words, in the order of (rank, start).

    ``ids`` numbers words, ``at`` has the windows' places in ``ids`` in ascending order.  A window and its source, and the next
    window and the word after the source, are one factor: its first window is compared whole, each
    further one by its last word.  Should a hash have misled, whole windows are compared instead.
    """

    def first(h: np.ndarray) -> np.ndarray:
        order = np.lexsort((start, rank, h))
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        lead = np.empty(len(h), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        return lead

    lead = first(rolling(mix(ids.astype(np.uint64)), width)[at])
    source = at[lead]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1] + 1)
    other = source != at
    heads = np.flatnonzero(other & ~goes_on)
    along = np.flatnonzero(other & goes_on)
    span = np.arange(width)
    same = np.array_equal(ids[at[along] + width - 1], ids[source[along] + width - 1]) and all(
        np.array_equal(ids[at[part, None] + span], ids[source[part, None] + span]) for part in np.array_split(heads, 1 + len(heads) // 100_000)
    )
    return lead if same else first(np.unique(ids[at[:, None] + span], axis=0, return_inverse=True)[1].reshape(-1))


def _later(ids: np.ndarray, at: np.ndarray, rank: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Which windows also stand earlier; a repeated row of one document is the same place, not a later one."""
    lead = sources(ids, at, rank, start, width)
    return (rank != rank[lead]) | (start != start[lead])


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` consecutive numbers from each start."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _starts(rank: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document with the starts of its windows."""
    order = np.lexsort((start, rank))
    rank, start = rank[order], start[order].astype("<u4")
    cuts = np.flatnonzero(np.diff(rank)) + 1
    for r, part in zip(rank[np.concatenate([[0], cuts])] if len(rank) else [], np.split(start, cuts), strict=False):
        yield int(r), part.tobytes()


class _Block:
    """The documents that a task has gathered: its reference block."""

    def __init__(self, width: int, index_blocks: int) -> None:
        self.width, self.index_blocks = width, index_blocks
        self.clear()

    def clear(self) -> None:
        self.windows = self.bytes = 0
        self.docs: list[tuple[int, int]] = []
        self.texts: list[bytes] = []
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, doc: tuple[int, int], text: bytes, n_words: int, start: np.ndarray, dealt: np.ndarray) -> None:
        """A document of ``n_words`` with the starts of windows that may be repeated, and hashes by which they are dealt."""
        self.docs.append(doc)
        self.texts.append(text)
        self.parts.append((n_words, start, (mix(dealt ^ np.uint64(1)) % np.uint64(self.index_blocks)).astype(np.int64)))
        self.windows += len(start)
        self.bytes += len(text)

    def flush(self) -> Iterator[dict]:
        if not self.windows:
            return
        ids, words = word_ids(pa.array(self.texts, pa.large_binary()))
        keys, rank = np.unique(np.array(self.docs, np.int64).reshape(-1, 2), axis=0, return_inverse=True)
        sizes = [len(s) for _, s, _ in self.parts]
        n_words = np.array([n for n, _, _ in self.parts], np.int64)
        base = np.repeat(np.cumsum(n_words) - n_words, sizes)
        rank = np.repeat(rank.reshape(-1), sizes)
        start = np.concatenate([s for _, s, _ in self.parts])
        index = np.concatenate([i for _, _, i in self.parts])
        self.clear()
        later = _later(ids, base + start, rank, start, self.width)
        # what is found here is known already and needs no group: it is dealt evenly, by document
        spread = mix(keys[:, 0].astype(np.uint64) ^ mix(keys[:, 1].astype(np.uint64))) % np.uint64(self.index_blocks)
        for doc, starts in _starts(rank[later], start[later]):
            yield {"index": int(spread[doc]), "keys": keys[doc].tobytes(), "starts": starts}
        base, rank, start, index = (x[~later] for x in (base, rank, start, index))
        if not len(start):
            return
        # runs of windows that go to one index block
        new = np.ones(len(start), bool)
        new[1:] = (base[1:] != base[:-1]) | (start[1:] != start[:-1] + 1) | (index[1:] != index[:-1])
        head = np.flatnonzero(new)
        order = head[np.argsort(index[head], kind="stable")]
        rows = np.empty(len(order), _ROW)
        rows["doc"], rows["start"] = rank[order], start[order]
        lengths = np.diff(np.append(head, len(start)))
        rows["n"] = lengths[np.searchsorted(head, order)]
        places = (base + start)[order]
        cuts = np.flatnonzero(np.diff(index[order])) + 1
        ends = [*cuts.tolist(), len(rows)]
        for a, b in zip([0, *ends], ends, strict=False):
            part, n = rows[a:b], rows["n"][a:b].astype(np.int64) + self.width - 1
            used, part["doc"] = np.unique(part["doc"], return_inverse=True)
            text = words.take(pa.array(_ranges(places[a:b], n)))
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(text)], text), pa.scalar(b" ", pa.large_binary()))
            yield {"index": int(index[order[a]]), "keys": keys[used].tobytes(), "runs": part.tobytes(), "words": joined[0].as_py()}


def _ship(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SHIP)


def duplicate_windows(
    texts: DataFrame, width: int, gram: int, bits: int, block_windows: int, index_windows: int
) -> DataFrame:
    """(``doc``, ``text_hash``, ``starts``): windows that stand earlier too; a document may have several rows.

    ``texts`` has ``doc``, ``text_hash`` and ``text``.
    """
    repeated, hot, places = anchor_tables(texts, width, gram, bits, max(1, index_windows // HOT_SHARE))
    index_blocks = 1 + places * (width - gram + 2) // 2 // index_windows
    shared = texts.sparkSession.sparkContext.broadcast((repeated, hot))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (repeated, hot), block = shared.value, _Block(width, index_blocks)
        for batch in batches_of(batches):
            docs = zip(batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)
            raw = column_bytes(batch.column("text"))
            for doc, text, hashed in zip(docs, raw, word_hashes(raw, SPACES), strict=True):
                anchor = anchors(hashed, width, gram)[0]
                n = numbers(anchor, bits)
                start = np.flatnonzero(_bit(repeated, n))
                if len(start):
                    whole = _bit(hot, n[start])
                    dealt = np.where(whole, rolling(hashed, width)[start], anchor[start]) if whole.any() else anchor[start]
                    block.add(doc, text, len(hashed), start, dealt)
                if block.windows >= block_windows or block.bytes >= BLOCK_BYTES:
                    yield _ship(list(block.flush()))
        yield _ship(list(block.flush()))

    def meet(group: pa.Table) -> pa.Table:
        out, rows, keys, texts, base = [], [], [], [], 0
        for row in group.to_pylist():
            if row["starts"] is not None:
                out.append((*np.frombuffer(row["keys"], np.int64).tolist(), row["starts"]))
                continue
            part = np.frombuffer(row["runs"], _ROW).copy()
            part["doc"] += base
            keys.append(np.frombuffer(row["keys"], np.int64).reshape(-1, 2))
            base += len(keys[-1])
            rows.append(part)
            texts.append(row["words"])
        if rows:
            every = np.concatenate(rows)
            ids = word_ids(pa.array(texts, pa.large_binary()))[0]
            ranked, rank = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
            n = every["n"].astype(np.int64)
            span = n + width - 1
            at = _ranges(np.cumsum(span) - span, n)
            rank = np.repeat(rank.reshape(-1)[every["doc"]], n)
            start = _ranges(every["start"].astype(np.int64), n)
            later = _later(ids, at, rank, start, width)
            out += [(int(ranked[d][0]), int(ranked[d][1]), s) for d, s in _starts(rank[later], start[later])]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    shipped = texts.mapInArrow(parse, "index long, keys binary, runs binary, words binary, starts binary")
    return shipped.groupBy("index").applyInArrow(meet, "doc long, text_hash long, starts binary")


def covered(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, list[dict]]:
    """Which of ``n`` words the windows cover, and the factors: maximal ranges of covered words."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    inside = np.cumsum(delta[:n]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return inside, [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def remove_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    width: int = WIDTH,
    gram: int = GRAM,
    table_bits: int = TABLE_BITS,
    block_windows: int = BLOCK_WINDOWS,
    index_windows: int = INDEX_WINDOWS,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``kept_text`` and ``spans`` (word ranges taken out).

    A word goes if a ``width``-word window over it stands earlier too: in a document of smaller key,
    or earlier in the same one.  What stays is joined by single blanks.

    A null key ranks first.  Rows of equal key rank by a hash of their texts; rows of equal key and
    text are one document and fare alike.  Null and empty texts have no words and keep an empty
    text.  An empty table gives an empty table.  A clashing column name is prefixed with ``_``.

    The broadcast tables have ``2 ** table_bits`` bits each whatever the input.  When anchors outnumber
    them, they let more unique windows through to the index, and the result stays the same.
    """
    n_words, kept, spans, k, t, s = fresh(docs, "n_words", "kept_text", "spans", "doc", "text_hash", "starts")
    keyed = docs.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))).withColumn(t, F.xxhash64(text))
    texts = keyed.select(F.col(k).alias("doc"), F.col(t).alias("text_hash"), F.col(text).alias("text"))
    found = duplicate_windows(texts, width, gram, table_bits, block_windows, index_windows)
    found = found.groupBy(F.col("doc").alias(k), F.col("text_hash").alias(t)).agg(F.collect_list("starts").alias(s))
    joined = keyed.join(found, [k, t], "left").drop(k, t)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(kept, T.StringType()), T.StructField(spans, span)]
    )

    own = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column=text):
            rows = []
            for raw, parts in zip(column_bytes(batch.column(text)), batch.column(s).to_pylist(), strict=True):
                words = raw.split()
                if not parts:
                    rows.append((len(words), b" ".join(words), []))
                    continue
                starts = np.unique(np.frombuffer(b"".join(parts), "<u4").astype(np.int64))
                inside, factors = covered(starts, width, len(words))
                rows.append((len(words), b" ".join(compress(words, (~inside).tolist())), factors))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            added = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                pa.array([r[2] for r in rows], kind),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], *added], [*own, n_words, kept, spans]
            )

    return joined.select(*own, s).mapInArrow(cut, schema)
