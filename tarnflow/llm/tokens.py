"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import written
from tarnflow.llm.words import SPACES, batches_of, column_bytes

#: Id that ends every document.
END = 2
#: Bytes of a stripe and rows between entries of its index.
STRIPE, STRIDE = 64 << 20, 10_000
#: Words whose ids a worker keeps, of plain ones and of others.
CACHE_WORDS = 500_000
#: Words that are handed to the tokenizer at once.
BATCH_WORDS = 2000
#: Bytes from which a text is encoded by pieces.
LONG = 8 << 20
#: ASCII punctuation but the apostrophe, and what it must follow to be a token run of its own.
TAIL, STEM_END = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}", frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: How a file must split its texts for words to be encoded one by one.  Fixed values.
_NORMAL = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_by_words(path: str) -> bool:
    """Whether a tokenizer's file says that a text's ids are its words' ids in order, and that a word's ASCII case does not count but where ``_keeps_case``."""
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    normal = (rules.get("normalizer") or {}).get("normalizers") or []
    split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    own = (split.get("pattern") or {}).get("Regex") == _SPLIT and split.get("behavior") == "Removed" and split.get("invert") is True
    special = all("<|" in t["content"] and not t["content"].split()[1:] and not t["normalized"] for t in rules.get("added_tokens") or [])
    return tuple(normal) == _NORMAL and own and special and rules["model"].get("end_of_word_suffix") == "</w>"


class TextEncoder:
    """Ids of whole texts by the library alone, for any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; the end id is not among them."""
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        ids = [np.array(x.ids, np.int32) for x in found]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)


class WordEncoder(TextEncoder):
    """Ids of whole texts, from the ids of their distinct words.

    The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids in
    order.  ASCII letters are lower-cased by the tokenizer itself, so words that differ by that
    share their ids, but for those of ``_keeps_case``.  Punctuation after a letter or digit is a token run of its own, so a word is its core and its tail.  Plain cores, of
    lower-case Latin-1 letters, are one token run that no normaliser changes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self.known: dict[bytes, np.ndarray] = {}
        self.cores, self.core_ids, self.core_sizes = pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        # plain cores need no normaliser and no pattern, and each ends with its one end-of-word token
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _plain_ids(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct plain cores in a row, and how many each has.

        Cores of earlier batches are kept, up to a number; beyond it only those of the last batch are.
        """
        at = pc.index_in(cores, value_set=self.cores)
        new = np.asarray(pc.is_null(at))
        fresh, sizes = self._tokenize(cores.filter(pa.array(new)))
        cut = np.cumsum(self.core_sizes) - self.core_sizes
        place = np.where(new, 0, np.asarray(pc.fill_null(at, 0)))
        size = np.zeros(len(cores), np.int64)
        size[new], size[~new] = sizes, self.core_sizes[place[~new]]
        start = np.zeros(len(cores), np.int64)
        start[new], start[~new] = len(self.core_ids) + np.cumsum(sizes) - sizes, cut[place[~new]]
        both = np.concatenate([self.core_ids, fresh])
        ids = both[_places(start, size)]
        if len(self.cores) + len(sizes) <= CACHE_WORDS:
            self.cores = pa.concat_arrays([self.cores, cores.filter(pa.array(new))])
            self.core_ids, self.core_sizes = both, np.concatenate([self.core_sizes, sizes])
        else:
            self.cores, self.core_ids, self.core_sizes = cores, ids, size
        return ids, size

    def _tokenize(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(cores), BATCH_WORDS):
            part = cores[at : at + BATCH_WORDS].to_pylist()
            found = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != len(part):
                each = self._other_ids(part)
                found, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _other_ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some distinct words."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        for at in range(0, len(new), BATCH_WORDS):
            part = new[at : at + BATCH_WORDS]
            texts = [w.decode("utf-8", "replace") for w in part]
            found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(part)))
            known.update(zip(part, np.split(np.array(found.ids, np.int32), ends), strict=True))
        return [known[w] for w in words]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        cores = pc.ascii_rtrim(words.cast(pa.large_string(), safe=False), characters=TAIL.decode()).cast(pa.large_binary())
        plain = _is_plain(cores)
        rest = np.flatnonzero(~plain)
        cut, tails = [], []
        for w in words.take(pa.array(rest)).to_pylist():
            core = w.rstrip(TAIL)
            whole = len(core) == len(w) or not core or core[-1] not in STEM_END or b"<|" in w
            cut.append(w if whole else core)
            tails.append(b"" if whole else w[len(core) :])
        tail = _after(words, cores).filter(pa.array(plain)).dictionary_encode()
        core = cores.filter(pa.array(plain)).dictionary_encode()
        ids, sizes = self._plain_ids(core.dictionary)
        named = [*tail.dictionary.to_pylist(), *cut, *tails]
        number = {w: i for i, w in enumerate(dict.fromkeys(named))}
        number.setdefault(b"", len(number))
        others = self._other_ids(list(number))
        pool = np.concatenate([ids, *others])
        size = np.concatenate([sizes, [len(x) for x in others]]).astype(np.int64)
        start = np.cumsum(size) - size
        # every word is two runs of the pool: a core and a tail
        runs = np.empty((len(words), 2), np.int64)
        runs[plain, 0] = core.indices.to_numpy()
        at_tail = np.array([number[w] for w in tail.dictionary.to_pylist()], np.int64) + len(sizes)
        runs[plain, 1] = at_tail[tail.indices.to_numpy()] if len(at_tail) else 0
        runs[rest, 0] = np.array([number[w] for w in cut], np.int64) + len(sizes)
        runs[rest, 1] = np.array([number[w] for w in tails], np.int64) + len(sizes)
        return pool[_places(start[runs].reshape(-1), size[runs].reshape(-1))], size[runs].sum(axis=1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if any(len(t) > LONG for t in texts):
            # a long text goes by pieces, cut at white space
            done = [[self._encode([p]) for p in SPACES.pieces(t)] for t in texts]
            sizes = [sum(int(n[0]) for _, n in own) for own in done]
            return np.concatenate([ids for own in done for ids, _ in own]), np.array(sizes, np.int64)
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        written = split.values.dictionary_encode()
        kept = pa.array(_keeps_case(written.dictionary.cast(pa.large_binary())))
        words = pc.if_else(kept, written.dictionary, pc.ascii_lower(written.dictionary)).cast(pa.large_binary()).dictionary_encode()
        pool, size = self._word_ids(words.dictionary)
        at = words.indices.to_numpy()[written.indices.to_numpy()]
        n = size[at]
        before = np.concatenate([[0], np.cumsum(n)])
        return pool[_places((np.cumsum(size) - size)[at], n)], np.diff(before[split.offsets.to_numpy()])


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` consecutive places from each start."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary words in a row, and where each starts and the last ends."""
    words = pa.concat_arrays([words])
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _keeps_case(words: pa.Array) -> np.ndarray:
    """Whether words must keep their case: with a capital before a character beyond ASCII, which may compose with it
    and not with the small letter or the other way round; or with ``<|``, where a special token may stand."""
    data, offsets = _bytes_of(words)
    first, second = data[:-1], data[1:]
    found = ((first >= 0x41) & (first <= 0x5A) & (second >= 0x80)) | ((first == 0x3C) & (second == 0x7C))
    upto = np.concatenate([[0], np.cumsum(found), [0]])
    # pairs that begin in the word and end in it
    return upto[np.maximum(offsets[1:] - 1, offsets[:-1])] > upto[offsets[:-1]]


def _is_plain(words: pa.Array) -> np.ndarray:
    """Whether words are of lower-case Latin-1 letters, one or more."""
    data, offsets = _bytes_of(words)
    lead = np.zeros(len(data) + 2, bool)
    lead[1:-1] = data == 0xC3
    follows = np.zeros(len(data) + 2, bool)
    follows[1:-1] = (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7)
    good = ((data >= 0x61) & (data <= 0x7A)) | (lead[1:-1] & follows[2:]) | (follows[1:-1] & lead[:-2])
    bad = np.concatenate([[0], np.cumsum(~good)])
    return (bad[offsets[1:]] == bad[offsets[:-1]]) & (np.diff(offsets) > 0)


def _after(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What words have after their cores."""
    data, offsets = _bytes_of(words)
    core = np.asarray(pc.binary_length(cores)).astype(np.int64)
    n = np.diff(offsets) - core
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    tails = np.ascontiguousarray(data[_places(offsets[:-1] + core, n)])
    return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(tails)])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of a file, made once a worker: by words where the file allows it, else by whole texts."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (WordEncoder if splits_by_words(path) else TextEncoder)(path)
    return _ENCODERS[path]


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, *, text: str = "text", key: str = "doc_id", end: int = END
) -> None:
    """ORC files of (``doc_id``, ``place``, ``ids``) under ``path``, in ascending order of the key.

    Files follow one another in key order, as their names do; ``place`` is the row's place in its
    file.  A null or empty text has the end id alone.  A null key comes first.  Rows of equal key
    stand in the order of a hash of their texts.  An empty table gives no rows.

    ``tokenizer`` is a file of the tokenizers library that executors can read.  Any file will do: one
    whose rules let words be encoded one by one is used so, and any other gets whole texts.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("order", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order")
    kinds = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, place = encoder(tokenizer), 0
        for batch in batches_of(batches, 8 << 20):
            ids, sizes = found.encode(column_bytes(batch.column("text")))
            flat = np.insert(ids, np.cumsum(sizes), end).astype(np.int32, copy=False)
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
            places = np.arange(place, place + len(sizes))
            place += len(sizes)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(places), lists], schema=kinds)

    (
        rows.select("doc_id", "text")
        .mapInArrow(run, "doc_id long, place long, ids array<int>")
        .write.option("orc.stripe.size", str(STRIPE))
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "lz4")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(``doc_id``, ``place``, ``ids``, ``file``) from the files; a filter on ``doc_id`` skips stripes.

    What was written comes back row by row: null ids, repeated rows and empty texts (the end id alone)
    too.  Files without rows give none.
    """
    rows = spark.read.schema("doc_id long, place long, ids array<int>").orc(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def token_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``start`` (ids before it), ``n_tokens`` and the crc32 of its ids.

    Repeated rows and null ids are documents like others; no files, no rows.
    Sums run within a file; files start where the files before them end, which takes one row a file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.asarray(ids.offsets)
            flat = np.asarray(ids.values).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "place", "file")], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "place", "file", "n_tokens", "ids_crc32"],
            )

    # a few numbers a document, written once: files are read and digested once for both sums
    rows = read_token_ids(spark, path).mapInArrow(digest, "doc_id long, place long, file string, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-ledger")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
