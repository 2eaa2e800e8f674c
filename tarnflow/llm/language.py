"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound by multiplying its letters'
vectors, each rotated by its place; a text is the bundle (sum) of its trigrams, and a language the
bundle of its texts.  A text gets the language whose profile has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.shared import fresh
from tarnflow.llm.words import batches_of, mix

#: Dimensions of a vector; languages that profiles may have.
DIM, MAX_LANGUAGES = 1024, 1024
UNKNOWN = "und"
#: Characters handled at once; cells of a matrix of counts; trigrams whose vectors are made at once.
PIECE, CELLS, ROWS = 1 << 20, 1 << 21, 1024
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A vector of +1 and -1 for each code point, drawn from the code point itself."""
    block = np.arange(dim // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[:, None] + block[None, :])
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = text.find(" ", at + PIECE, at + 2 * PIECE)
        cut = cut if cut >= 0 else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _bundles(texts: list[str], dim: int) -> np.ndarray:
    """The bundle of each text; word ends count as a letter, trigrams across a word end do not."""
    joined = " ".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.concatenate([owner, owner[-1:]])
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[keep], owner[keep]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    letters, k = rank[codes], len(alphabet)
    inner = codes[1:-1] != 0
    grams = ((letters[:-2] * k + letters[1:-1]) * k + letters[2:])[inner]
    owner = owner[1:-1][inner]
    if k**3 <= CELLS:
        there = np.zeros(k**3, bool)
        there[grams] = True
        unique = np.flatnonzero(there)
        place = np.zeros(k**3, np.int64)
        place[unique] = np.arange(len(unique))
        grams = place[grams]
    else:
        unique, grams = np.unique(grams, return_inverse=True)
    out = np.zeros((len(texts), dim), np.float64)
    base = letter_vectors(alphabet, dim)
    first, middle = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    step = max(1, CELLS // max(1, len(unique)))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for d in range(0, len(texts), step):
        top = min(len(texts), d + step)
        part = slice(bounds[d], bounds[top])
        cells = (owner[part] - d) * len(unique) + grams[part]
        counts = np.bincount(cells, minlength=(top - d) * len(unique)).reshape(top - d, -1).astype(np.float32)
        for u in range(0, len(unique), ROWS):
            g = unique[u : u + ROWS]
            bound = first[g // (k * k)] * middle[g // k % k] * base[g % k]
            out[d:top] += counts[:, u : u + ROWS] @ bound
    return out


def bundles(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The bundle of each text; of whole texts, long ones by pieces."""
    out, owner, group, size = np.zeros((len(texts), dim)), [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            owner.append(i)
            group.append(piece)
            size += len(piece)
            if size >= PIECE or len(group) == 512:
                np.add.at(out, owner, _bundles(group, dim))
                owner, group, size = [], [], 0
    if group:
        np.add.at(out, owner, _bundles(group, dim))
    return out


def learn_profiles(labelled: DataFrame, text: str, lang: str, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, by name, and their profiles as unit vectors.

    Tasks bundle their own texts; the sums of whole numbers meet by (language, dimension), so the
    result does not depend on the order of additions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                ["lang", "profile"],
            )

        for batch in batches_of(batches):
            names = batch.column("lang").to_pylist()
            vectors = np.rint(bundles(batch.column("text").to_pylist(), dim)).astype(np.int64)
            for name in set(names):
                mine = vectors[[n == name for n in names]].sum(axis=0)
                sums[name] = sums[name] + mine if name in sums else mine
            if len(sums) > 256:
                yield out()
                sums.clear()
        yield out()

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    summed = rows.mapInArrow(run, "lang string, profile array<long>")
    cells = summed.select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    vectors = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("profile"))
    found = vectors.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r.lang, [x.v for x in r.profile]) for r in found)
    profiles = np.array([p for _, p in found], np.float64).reshape(-1, dim)
    norms = np.linalg.norm(profiles, axis=1, keepdims=True)
    return [name for name, _ in found], profiles / np.where(norms > 0, norms, 1)


def identify(
    docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", dim: int = DIM
) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``, the cosine, at least 0.

    Profiles are learnt from the text and language of rows where ``train`` holds and the language
    is not null.  A null text, or one without letters, is ``und`` with score 0; so are all texts if
    nothing can be learnt.  Ties go to the name that sorts first.  Repeated rows fare alike.  An
    empty table gives an empty table.  A clashing column name is prefixed with ``_``.
    """
    names, profiles = learn_profiles(docs.where(train), text, lang, dim)
    pred, score = fresh(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha = _letters()
        for batch in batches_of(batches, column=text):
            texts = batch.column(text).to_pylist()
            vectors = bundles(texts, dim)
            norms = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ profiles.T / np.where(norms > 0, norms, 1)[:, None]
            best = cosine.argmax(axis=1) if len(names) else np.zeros(len(texts), int)
            lettered = [bool(t) and any(alpha[ord(c)] for c in t) for t in texts]
            known = [x and bool(names) for x in lettered]
            langs = [names[b] if x else UNKNOWN for b, x in zip(best, known, strict=True)]
            scores = [min(1.0, max(0.0, float(cosine[i, b]))) if x else 0.0 for i, (b, x) in enumerate(zip(best, known, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, pred, score],
            )

    return docs.mapInArrow(run, schema)
