"""Two tokenizers' ids of the same texts, aligned where tokens of both end at the same byte."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import forget, written
from tarnflow.llm.words import batches_of, column_bytes

#: Bytes of text handled at once, pairs that a task counts before it sends them on.
BATCH, COUNTED = 4 << 20, 2_000_000
#: How a byte-level file splits a text where it says no more.  A fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of ids up to which their counts are sent to the tasks (some 70 MB); beyond, tables of BLOCK_PAIRS meet the links by a shuffle.
SENT_PAIRS, BLOCK_PAIRS = 4_000_000, 1_000_000
_LOW = (1 << 32) - 1


class _Tokenizer:
    """Ids of pieces of text, and the bytes of each id."""

    #: Bytes of pieces that are handed over at once.
    handed = 1 << 16

    def __init__(self, entries: list[bytes]) -> None:
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a line feed, without those of the line feed."""
        raise NotImplementedError

    def tokens(self, pieces: list[bytes], size: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.

        Pieces that may be joined are handed over many at once, with a line feed, a token of its own on
        either side, between them; where the ends of tokens are not those of pieces, one by one.
        """
        ids, counts = [np.zeros(0, np.int64)], np.zeros(len(pieces), np.int64)
        together = np.flatnonzero(joins)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[together]) // self.handed)) + 1
        alone, order = np.flatnonzero(~joins).tolist(), []
        for own in np.split(together, cuts) if len(together) else []:
            part = [pieces[i] for i in own.tolist()]
            found = np.array(self.encode(b"\n".join([b"", *part, b""]).decode("utf-8", "replace")), np.int64)
            ends = np.cumsum(self.sizes[found])
            want = np.cumsum(size[own] + 1)
            last = np.searchsorted(ends, want)
            # the line feed after each piece is one token, and so is what stands before it the piece's
            if ends[-1] != want[-1] or (ends[last] != want).any() or (self.sizes[found[last]] != 1).any():
                alone += own.tolist()
                continue
            keep = np.ones(len(found), bool)
            keep[last] = False
            ids.append(found[keep])
            counts[own] = np.diff(last, prepend=-1) - 1
            order.append(own)
        for i in alone:
            found = np.array(self.encode("\n" + pieces[i].decode("utf-8", "replace")), np.int64)
            ids.append(found)
            counts[i] = len(found)
        order = np.concatenate([*order, np.array(alone, np.int64)]) if pieces else np.zeros(0, np.int64)
        given, at = np.concatenate(ids), np.zeros(len(pieces), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return given[_runs(at, counts)], counts


class ByteLevel(_Tokenizer):
    """A byte-level file of the tokenizers library.  Its pattern lets no token run from anything into a space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # bytes that print stand for themselves, the others, in order, for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(entries)
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        split = rules.get("pre_tokenizer") or {}
        self.cuts_before_spaces = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.ranked = self._by_ranks(rules, entries) if self.cuts_before_spaces else None

    @staticmethod
    def _by_ranks(rules: dict, entries: list[bytes]) -> object | None:
        """The same tokenizer in a library that merges by rank and is quicker; only if the file's merges are in the order of their ids."""
        model, special = rules["model"], {t["content"] for t in rules.get("added_tokens") or []}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or model.get("ignore_merges") or model.get("dropout"):
            return None
        import tiktoken

        ranks = {entries[i]: i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        # the line feed goes, as it would join white space at the start of a piece
        if self.ranked is not None:
            return self.ranked.encode_ordinary(text[1:])
        return self.tokenizer.encode(text[1:], add_special_tokens=False).ids


class Pieces(_Tokenizer):
    """A SentencePiece model, which itself puts a space before a text."""

    handed = 1 << 12

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.cuts_before_spaces = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, text: str) -> list[int]:
        # the space that the model puts first and the line feed stay tokens of their own, as no piece has a line feed
        return self.model.encode(text, num_threads=1)[2:]


def cut_places(data: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each byte: before a space that follows printing ASCII or any other character that is no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    one = data[at - 1]
    good = (one > 0x20) & (one != 0x7F)
    far = np.flatnonzero(good & (one >= 0x80))
    if len(far):
        padded = np.concatenate([np.zeros(3, np.uint8), data])
        place, last = at[far] + 3, one[far]
        two, three = padded[place - 2], padded[place - 3]
        # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
        general = (two == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)) | (two == 0x81) & (last == 0x9F)
        space = (two == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (three == 0xE2) & general
        space |= (three == 0xE1) & (two == 0x9A) & (last == 0x80) | (three == 0xE3) & (two == 0x80) & (last == 0x80)
        good[far[space]] = False
    out = np.zeros(len(data), bool)
    out[at[good]] = True
    return out


def _bitset(places: np.ndarray, size: int) -> np.ndarray:
    """A packed bitset of 64-bit words with the given places set."""
    bits = np.zeros(-(-max(size, 1) // 64) * 64, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def _rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place: popcounts of whole words, then of the place's own."""
    counts = np.bitwise_count(words).astype(np.int64)
    at = places >> 6
    upto = (np.uint64(2) << (places & 63).astype(np.uint64)) - np.uint64(1)
    return (np.cumsum(counts) - counts)[at] + np.bitwise_count(words[at] & upto)


def _select(words: np.ndarray) -> np.ndarray:
    """The places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` consecutive numbers from each start."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Aligned:
    """Distinct pieces of text with their tokens of both sides, groups and links, as flat arrays."""

    def __init__(self, given: pa.Array, a: _Tokenizer, b: _Tokenizer) -> None:
        """``given`` is of large binary values and begins with its buffer."""
        n, pieces = len(given), given.to_pylist()
        sides, self.good = [], np.ones(n, bool)
        sizes = np.diff(np.frombuffer(given.buffers()[1], np.int64)[: n + 1])
        data = np.frombuffer(given.buffers()[2], np.uint8)[: int(sizes.sum())]
        joins = _may_join(data, sizes)
        for side in (a, b):
            ids, count = side.tokens(pieces, sizes, joins)
            owner = np.repeat(np.arange(n), count)
            whole = np.bincount(owner, side.sizes[ids], n).astype(np.int64) == sizes
            # bytes are compared where there are as many
            same = side.bytes_of(ids[whole[owner]]) == data[np.repeat(whole, sizes)]
            wrong = np.bincount(np.repeat(np.flatnonzero(whole), sizes[whole])[~same], minlength=n) > 0
            self.good &= whole & ~wrong
            sides.append((ids, owner, count))
        good = self.good
        self.sides = [(ids[good[owner]], np.where(good, count, 0)) for ids, owner, count in sides]
        size = int(sizes[good].sum())
        ends = [np.cumsum(side.sizes[ids]) - 1 for side, (ids, _) in zip((a, b), self.sides, strict=True)]
        marks = [_bitset(e, size) for e in ends]
        shared = marks[0] & marks[1]
        cuts = _select(shared)
        self.ranges = [np.concatenate([[0], _rank(m, cuts)]) for m in marks]
        last = np.cumsum(sizes[good])
        self.n_groups = np.zeros(n, np.int64)
        self.n_groups[good] = np.diff(np.searchsorted(cuts, last), prepend=0)
        self.n_a, self.n_b = (count for _, count in self.sides)
        self._link(n)

    def _link(self, n: int) -> None:
        """All pairs of ids within a group, each once a piece with how often it occurs: first once an id and group, then as products."""
        groups = len(self.ranges[0]) - 1
        owner = np.repeat(np.arange(n), self.n_groups)
        own = []
        for (ids, _), cut in zip(self.sides, self.ranges, strict=True):
            group = np.repeat(np.arange(groups), np.diff(cut))
            key, times = np.unique(group << 32 | ids, return_counts=True)
            own.append((key >> 32, key & _LOW, times))
        (ga, ia, ta), (gb, ib, tb) = own
        many = np.bincount(gb, minlength=groups)
        first = np.cumsum(many) - many
        left = np.repeat(np.arange(len(ga)), many[ga])
        right = _runs(first[ga], many[ga])
        pair, times, piece = ia[left] << 32 | ib[right], ta[left] * tb[right], owner[ga[left]]
        order = np.lexsort((pair, piece))
        pair, times, piece = pair[order], times[order], piece[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (piece[1:] != piece[:-1])
        at = np.flatnonzero(new)
        self.pairs, self.times = pair[at], np.add.reduceat(times, at) if len(at) else times
        self.n_pairs = np.bincount(piece[at], minlength=n)
        self.first_pair = np.cumsum(self.n_pairs) - self.n_pairs
        self.n_links = np.bincount(piece[at], self.times, n).astype(np.int64)

    def printed(self) -> pa.Array:
        """Per piece its groups in decimal: ``a1,a2|b1;a3|b2,b3``."""
        texts = []
        for (ids, _), cut in zip(self.sides, self.ranges, strict=True):
            lists = pa.LargeListArray.from_arrays(pa.array(cut), pa.array(ids).cast(pa.large_string()))
            texts.append(pc.binary_join(lists, pa.scalar(",", pa.large_string())))
        both = pc.binary_join_element_wise(*texts, pa.scalar("|", pa.large_string()))
        offsets = np.concatenate([[0], np.cumsum(self.n_groups)])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), both), pa.scalar(";", pa.large_string()))


def _may_join(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces that begin with a space and something that is no white space, and end with such: a line feed
    before and after them changes nothing.  Of characters beyond ASCII, none of those among which white space is."""
    data = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)])
    start = np.cumsum(sizes) - sizes + 2
    second, last, before, third = data[start + 1], data[start + sizes - 1], data[start + sizes - 2], data[start + sizes - 3]
    shows = lambda c: (c > 0x20) & (c != 0x7F)
    lead = lambda c: (c == 0xC2) | ((c >= 0xE1) & (c <= 0xE3))
    return (sizes > 1) & (data[start] == 0x20) & shows(second) & ~lead(second) & shows(last) & ~((last >= 0x80) & (lead(before) | lead(third)))


class Read:
    """Texts as runs of distinct pieces: ``place`` numbers the pieces of all texts in a row, ``counts`` says how many
    each text has (none, for one without tokens), ``pieces`` has them aligned."""

    def __init__(self, texts: list[bytes], a: _Tokenizer, b: _Tokenizer) -> None:
        full = [t for t in texts if t]
        self.place, self.counts, self.pieces = np.zeros(0, np.int64), np.zeros(len(texts), np.int64), None
        if not full:
            return
        data = np.frombuffer(b"".join(b" " + t for t in full), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in full], dtype=np.int64)
        begins = cut_places(data) if a.cuts_before_spaces and b.cuts_before_spaces else np.zeros(len(data), bool)
        begins[0] = True
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        self.pieces = Aligned(cut.dictionary, a, b)
        place = cut.indices.to_numpy()
        sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
        owner = np.repeat(np.arange(len(full)), sizes)
        broken = np.bincount(owner, ~self.pieces.good[place], len(full)) > 0
        self.counts[[bool(t) for t in texts]] = np.where(broken, 0, sizes)
        self.place = place[~broken[owner]].astype(np.int64)

    def sums(self, values: np.ndarray) -> pa.Array:
        """Per text the sum of a value of its pieces."""
        return pa.array(_over(values[self.place], self.counts))

    def numbers(self) -> list[pa.Array]:
        """Per text its tokens, groups and links, and its groups in decimal."""
        if not len(self.place):
            return [pa.array(np.zeros(len(self.counts), np.int64))] * 4 + [pa.array([""] * len(self.counts), pa.large_string())]
        own = self.pieces
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.counts)])), own.printed().take(pa.array(self.place)))
        return [*(self.sums(x) for x in (own.n_a, own.n_b, own.n_groups, own.n_links)), pc.binary_join(lists, pa.scalar(";", pa.large_string()))]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each text: the text, the pair, and how often it occurs there."""
        if not len(self.place):
            return self.place, self.place, self.place
        own = self.pieces
        n = len(own.good)
        key, times = np.unique(np.repeat(np.arange(len(self.counts)), self.counts) * n + self.place, return_counts=True)
        owner, piece = key // n, key % n
        many = own.n_pairs[piece]
        at = _runs(own.first_pair[piece], many)
        distinct, number = np.unique(own.pairs, return_inverse=True)
        key = np.repeat(owner, many) * len(distinct) + number[at]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], (np.repeat(times, many) * own.times[at])[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        return key[new] // len(distinct), distinct[key[new] % len(distinct)], np.add.reduceat(weight, new)


_SIDES: dict[str, _Tokenizer] = {}


def read(texts: list[bytes], a: str, b: str) -> Read:
    """Texts read by the tokenizers of two files, which are opened once a worker."""
    for path, kind in ((a, ByteLevel), (b, Pieces)):
        if path not in _SIDES:
            _SIDES[path] = kind(path)
    return Read(texts, _SIDES[a], _SIDES[b])


def _over(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _count_pairs(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ids with the number of texts that link them; a task adds up its own before it sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches_of(batches, BATCH):
            _, pair, _ = read(column_bytes(batch.column("text")), a, b).links()
            found, n = np.unique(pair, return_counts=True)
            both, place = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            pairs, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(pairs) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(texts: DataFrame, table: DataFrame, a: str, b: str, schema: str) -> DataFrame:
    """With the counts of all pairs sent to the tasks."""
    found = table.toArrow()
    pairs, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    sent = texts.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches_of(batches, BATCH):
            found = read(column_bytes(batch.column("text")), a, b)
            *numbers, printed = found.numbers()
            scores = [pa.array(np.zeros(len(found.counts), np.int64))] * 2
            if len(found.place):
                own = found.pieces
                # pieces of texts without tokens may have pairs that nobody counted
                row = np.minimum(np.searchsorted(pairs, own.pairs), len(pairs) - 1)
                scores = [found.sums(_over(own.times * value[row], own.n_pairs)) for value in (best, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *scores, printed], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return texts.mapInArrow(run, schema)


def _joined(texts: DataFrame, table: DataFrame, n_pairs: int, a: str, b: str, kind: str) -> DataFrame:
    """With the counts in blocks by pair, which meet the links of batches of documents by a shuffle.

    Every document's links go to all blocks alike, so the blocks are equally large, and each is given
    out ``salts`` times.
    """
    spark = texts.sparkSession
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    blocks = max(1, -(-n_pairs // BLOCK_PAIRS))
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches_of(batches, BATCH):
            found = read(column_bytes(batch.column("text")), a, b)
            counts, (owner, pair, times) = found.counts, found.links()
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair, times)]
            rows = pa.array(row + np.arange(len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), *found.numbers(), *lists], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            rows = np.repeat(np.asarray(batch.column("row")), np.diff(np.asarray(lists.offsets)))
            pair, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten())
            block = _block(pair, blocks)
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            at = int(rows[0]) if len(rows) else 0
            out = [(k, order[cut[k] : cut[k + 1]]) for k in range(blocks) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k * salts + (at * 31 + k) % salts for k, _ in out], pa.int64()), pa.array([1] * len(out), pa.int32()),
                 *(pa.array([v[o].tobytes() for _, o in out], pa.binary()) for v in (rows, pair, times))],
                ["cell", "kind", "x", "y", "z"],
            )

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n, best = (np.asarray(batch.column(c)) for c in ("pair", "n", "best"))
            block = _block(pair, blocks)
            own = [(k, block == k) for k in np.unique(block).tolist()]
            cells = [(k * salts + s, m) for k, m in own for s in range(salts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in cells], pa.int64()), pa.array([0] * len(cells), pa.int32()), *(pa.array([v[m].tobytes() for _, m in cells], pa.binary()) for v in (pair, n, best))],
                ["cell", "kind", "x", "y", "z"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != at:
                    at, held, known = r["cell"], [], None
                x, y, z = (np.frombuffer(r[c], np.int64) for c in ("x", "y", "z"))
                if r["kind"] == 0:
                    held.append((x, y, z))
                    continue
                if known is None:
                    known = [np.concatenate(p) for p in zip(*held, strict=True)]
                    order = np.argsort(known[0])
                    known, held = [p[order] for p in known], []
                place = np.searchsorted(known[0], y)
                rows, number = np.unique(x, return_inverse=True)
                sums = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
                np.add.at(sums[0], number, z * known[2][place])
                np.add.at(sums[1], number, z * known[1][place])
                yield pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

    numbers = "n_a long, n_b long, n_groups long, n_links long, groups string"
    docs = written(texts.mapInArrow(digest, f"row long, doc_id {kind}, {numbers}, pairs array<long>, times array<long>"), "aligned")
    packed = "cell long, kind int, x binary, y binary, z binary"
    rows = docs.select("row", "pairs", "times").mapInArrow(deal, packed).union(table.mapInArrow(tables, packed))
    rows = rows.repartition(blocks * salts, "cell").sortWithinPartitions("cell", "kind")
    sums = rows.mapInArrow(meet, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return docs.drop("pairs", "times").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def _block(pair: np.ndarray, blocks: int) -> np.ndarray:
    return ((pair >> 32) * 31 + (pair & _LOW)) % blocks


def align_tokenizers(docs: DataFrame, a: str, b: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its two token sequences, cut into groups where tokens of both end at the same byte.

    ``a`` is a byte-level file of the tokenizers library, which gets a space and the text, ``b`` a
    SentencePiece model, which puts that space before the text itself.  Columns: the key as ``doc_id``,
    ``n_a, n_b, n_groups, n_links`` (pairs of an ``a`` and a ``b`` token of one group), ``groups``
    (``a1,a2|b1;a3|b2,b3`` in decimal), ``count_sum`` (over links, in how many documents of the corpus the
    pair of ids is linked) and ``n_best`` (links whose count is the highest of their ``a`` id, ties included).

    Null and empty texts have no tokens, nor have texts which the tokens of a side do not spell byte
    by byte (as with U+2581 in it); their numbers are 0 and ``groups`` is empty.  Repeated rows and
    ids, null ids too, are documents each.  No rows give no rows.  Special tokens in texts are plain text.

    Texts are cut before spaces where both tokenizers begin a token by their rules; each distinct piece
    of a batch is aligned once, by packed bitsets of token ends.  A text without such places is one piece.
    The corpus is read twice: to count pairs, and to score them.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    table = _count_pairs(texts.select("text"), a, b)
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    table = written(table.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("long")), "pair-counts")
    n_pairs, kind = table.count(), texts.schema["doc_id"].dataType.simpleString()
    if n_pairs > SENT_PAIRS:
        return _joined(texts, table, n_pairs, a, b, kind)
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    out = _scored(texts, table, a, b, schema)
    forget(table)
    return out
