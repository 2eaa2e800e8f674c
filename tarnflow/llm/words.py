"""Words of whole texts as arrays: split and hashed by numpy over the bytes of many texts at once.

A rule for words is a set of separator bytes below 0x80, so a UTF-8 text splits by bytes as it would
by characters.  Texts longer than a piece are cut at separators, so memory follows the piece and
eight bytes a word, not the text's bytes times eight.  Hashes find candidates; what is decided by
words compares words (``word_ids`` numbers them exactly).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes handled at once.
PIECE = 1 << 20
_U = np.uint64
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: What eight bytes are cut to, by the number that count; words of more bytes than the second are hashed one by one.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
LONG_WORD = 64


class WordRule:
    """Which bytes separate words, and whether A-Z are lower-cased."""

    def __init__(self, separators: Iterable[int], lower: bool = False) -> None:
        self.separators, self.lower = bytes(sorted(separators)), lower
        self.inside = np.ones(256, bool)
        self.inside[list(self.separators)] = False
        self.gap = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in self.separators) + b"]")

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """The text, cut at separators into pieces of about ``PIECE`` bytes."""
        at = 0
        while len(text) - at > 2 * PIECE:
            found = self.gap.search(text, at + PIECE)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:] if at else text

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text."""
        return [w for w in self.gap.split(text.lower() if self.lower else text) if w]

    def bounds(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in a buffer of bytes."""
        inside = np.zeros(len(buffer) + 2, bool)
        inside[1:-1] = self.inside[buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]


SPACES = WordRule([0x20, *range(0x09, 0x0E)])
SPACES_LOWER = WordRule([0x20, *range(0x09, 0x0E)], lower=True)
ALNUM_LOWER = WordRule([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word: its length, then its bytes, eight at a time, each mixed into what stands before."""
    sizes = ends - starts
    h = mix(sizes.astype(_U) * _BASE)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(sizes, 8)])) if len(h) else h
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    done = 8
    while len(rest):
        part = eight[starts[rest] + done] & _MASKS[np.minimum(sizes[rest] - done, 8)]
        h[rest] = mix(h[rest] * _BASE2 ^ part)
        done += 8
        rest = rest[sizes[rest] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]])
    return h


def _groups(texts: list[bytes], rule: WordRule) -> Iterator[tuple[list[int], list[bytes]]]:
    """Indexes and pieces of texts, gathered to about ``PIECE`` bytes."""
    owner, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in rule.pieces(text):
            owner.append(i)
            parts.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield owner, parts
                owner, parts, size = [], [], 0
    if parts:
        yield owner, parts


def word_hashes(texts: list[bytes], rule: WordRule) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for owner, parts in _groups(texts, rule):
        joined = rule.separators[-1:].join(parts)
        if rule.lower:
            joined = joined.lower()
        buffer = np.frombuffer(joined, np.uint8)
        starts, ends = rule.bounds(buffer)
        hashes = _hashes(buffer, starts, ends)
        last = np.cumsum([len(p) + 1 for p in parts])
        cuts = np.searchsorted(starts, last)
        begin = 0
        for i, end in zip(owner, cuts.tolist(), strict=True):
            out[i].append(hashes[begin:end])
            begin = end
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, _U) for x in out]


def word_ids(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts (binary, split at ASCII white space) as numbers, equal for equal words only; the words themselves."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string(), safe=False)).flatten().cast(pa.large_binary())
    split = split.filter(pc.greater(pc.binary_length(split), 0))
    return split.dictionary_encode().indices.to_numpy(), split


def rolling(h: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive hashes, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    wrap = (1 << 64) - 1
    out, at, block, have, scale, lead = None, 0, h, 1, int(base), 1
    while at < width:
        if width & have:
            # out covers `at` items and stands before the block
            out = block if out is None else out[: len(block) - at] + _U(lead) * block[at : at + len(out)]
            at += have
            lead = lead * scale & wrap
        if at < width:
            block = block[:-have] + _U(scale) * block[have:]
            scale, have = scale * scale & wrap, 2 * have
    return mix(out[:n])


def sliding(h: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` consecutive values."""
    n, have, block = len(h) - width + 1, 1, h
    if n <= 0:
        return h[:0]
    while 2 * have <= width:
        block = op(block[:-have], block[have:])
        have *= 2
    return op(block[:n], block[width - have : width - have + n])


def column_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches_of(texts: Iterable[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most, or of one row."""
    for batch in texts:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
