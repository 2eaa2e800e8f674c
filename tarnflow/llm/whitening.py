"""Whitening of embeddings: a randomised range finder with power passes, and Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import written
from tarnflow.llm.vectors import as_type, pack, unpack, whole

#: Directions beyond those asked for, passes before the whole space is taken, columns of a pass.
OVERSAMPLE, PASSES, SLAB = 8, 5, 128
#: A direction is found when its residual is this part of the distance to the next eigenvalue.
FOUND = 1e-12
#: Variances below this part of the whole count as none.
NO_VARIANCE = 1e-12
SEED = 29


def _packed(vectors: DataFrame) -> DataFrame:
    """Each row that takes part as packed whole numbers ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, x = whole(batch.column("vector"))
            parts = np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pa.RecordBatch.from_arrays([pa.array([pack(p) for p in parts], pa.binary()), pa.array(sizes)], ["x", "dim"])

    return vectors.mapInArrow(run, "x binary, dim long")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Packed rows as matrices of doubles."""
    for batch in batches:
        if batch.num_rows:
            yield np.stack([unpack(x) for x in batch.column("x").to_pylist()]).astype(np.float64)


def _int_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole numbers."""
    if np.abs(x).max(initial=0) * len(x) < 1 << 62:
        return x.astype(np.int64).sum(axis=0).tolist()
    return as_type(x, object).sum(axis=0).tolist()


def _sums(fit: DataFrame, dim: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for x in _matrices(batches):
            total = [a + b for a, b in zip(total, _int_sums(x), strict=True)]
        kinds = [pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(kinds, ["i", "s"])

    rows = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def _summed(fit: DataFrame, mean: np.ndarray, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over the fit list of ``part``, a matrix of ``shape``, of its centred rows; summed within tasks, then by Spark."""
    names = [f"c{j}" for j in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _matrices(batches):
            total += part(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), *map(pa.array, total.T)], ["i", *names])

    rows = fit.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r["i"])])


def _times(fit: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The covariance times ``q``, and its trace, from all centred rows."""
    out, trace = [], 0.0
    for begin in range(0, q.shape[1], SLAB):
        part = q[:, begin : begin + SLAB]

        def product(c: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            return np.column_stack([c.T @ (c @ part), (c * c).sum(axis=0)])

        found = _summed(fit, mean, product, (len(q), part.shape[1] + 1)) / n
        out.append(found[:, :-1])
        trace = float(found[:, -1].sum())
    return np.column_stack(out), trace


def _ritz(q: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rayleigh-Ritz in the space of ``q``, of which ``w`` is the covariance's image: values, unit vectors, and whether the first ``k`` are found."""
    t = q.T @ w
    values, u = np.linalg.eigh((t + t.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    vectors = q @ u
    residual = np.linalg.norm(w @ u - vectors * values, axis=0)[:k]
    gaps = np.abs(values[:k, None] - values[None, :])
    gaps[np.arange(len(gaps)), np.arange(len(gaps))] = np.inf
    return values, vectors, bool((residual <= FOUND * gaps.min(axis=1, initial=np.inf)).all())


def principal_axes(fit: DataFrame, mean: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first ``k`` eigenvalues and unit eigenvectors (columns) of the fit list's covariance, and its trace.

    Each pass multiplies a basis of ``k`` and some more directions by the covariance.  If residuals
    say after ``PASSES`` of them that the directions are not found, the whole space is the basis.
    """
    dim = len(mean)
    width = min(dim, k + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    for _ in range(PASSES):
        w, trace = _times(fit, mean, q, n)
        values, vectors, found = _ritz(q, w, k)
        if found:
            break
        q = np.linalg.qr(w)[0]
    else:
        q = np.eye(dim)
        w, trace = _times(fit, mean, q, n)
        values, vectors, _ = _ritz(q, w, k)
    values, vectors = values[:k], vectors[:, :k]
    real = values > NO_VARIANCE * trace
    values, vectors = values[real], vectors[:, real]
    # either sign is right; the largest entry is made positive
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return values, vectors * signs, trace


def whiten(vectors: DataFrame, *, k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component up to ``k``: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become ``floor(256 * x)``.  The fit list has each distinct vector once, ``n`` of them;
    mean and covariance are over it.  ``deviation`` is exact, a decimal of 38 digits, null beyond.
    Rows that are null or hold null or non-finite entries are dropped; repeated rows and ids, null
    ids too, each give their rows; equal vectors give equal rows.  Components without variance (one
    vector, or fewer dimensions than ``k``) are left out; vectors of no entries and an empty table
    give no rows.  Vectors of different lengths are an error.

    The driver keeps a mean and matrices of ``k + OVERSAMPLE`` columns; only if the whole space has
    to be taken, one of the square of the dimension.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    fit = written(_packed(chosen.select("vector")).distinct(), "fit-list")
    dims = [r["dim"] for r in fit.select("dim").distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {dims[0]} and {dims[1]}, among others")
    dim = dims[0] if dims else 0
    values, axes, trace, n, total, error = np.zeros(0), np.zeros((dim, 0)), 0.0, 0, [0] * dim, 0.0
    if dim:
        n = fit.count()
        total = _sums(fit, dim)
        mean = np.array([t / n for t in total])
        values, axes, trace = principal_axes(fit, mean, n, k)
        if len(values):
            each = axes / np.sqrt(values)
            own = _summed(fit, mean, lambda c: (w := c @ each).T @ w, (len(values),) * 2) / n
            error = float(np.abs(own - np.eye(len(values))).max())
    id_type = chosen.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not len(values):
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast((total, axes / np.sqrt(values), values / trace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, each, explained = model.value
        mean, many = np.array([t / n for t in total]), len(explained)
        for batch in batches:
            rows, _, x = whole(batch.column("vector"))
            if not len(rows):
                continue
            x = x.reshape(len(rows), dim)
            repeat = pa.array(np.repeat(np.arange(len(rows)), many))
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(rows)).take(repeat),
                "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))),
                "n": pa.array(np.full(len(rows) * many, n, np.int64)),
                "deviation": _deviations(x, total, n).take(repeat),
                "whitened": pa.array(((x - mean) @ each).ravel()),
                "explained": pa.array(np.tile(explained, len(rows))),
                "identity_error": pa.array(np.full(len(rows) * many, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return chosen.mapInArrow(run, schema)


def _deviations(x: np.ndarray, total: list[int], n: int) -> pa.Array:
    """Per row the exact sum over dimensions of ``(n * x - total) ** 2``."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if most * most * len(total) < 1 << 62:
        d = n * x.astype(np.int64) - np.array(total, np.int64)
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    d = n * as_type(x, object) - np.array(total, object)
    return pa.array([Decimal(s) if s < 10**38 else None for s in (d * d).sum(axis=1).tolist()], pa.decimal128(38, 0))
