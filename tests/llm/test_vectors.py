"""Exact top-k search and whitening, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import topk as topk_module
from tarnflow.llm import whitening as whitening_module
from tarnflow.llm.topk import top_k
from tarnflow.llm.whitening import whiten

ROWS = "vec_id long, embedding array<double>, rank int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)


def plain(rows, k):
    """Whole numbers by Python, all pairs of equal length."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), -(2**63) if j is None else j) for n, (j, v) in enumerate(kept) if n != at and len(v) == len(q)]
            out += [(i, r + 1, None if j == -(2**63) else j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted(map(tuple, top_k(table(spark, rows), F.col("vec_id") % 50 == 0, **options).collect()), key=str)


def some(n, dim, seed, copies=0.3):
    """A third of the rows are copies of one vector, so that scores tie."""
    r = np.random.default_rng(seed)
    hot = r.normal(size=dim).tolist()
    return [(i, hot if r.random() < copies else r.normal(size=dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_all_pairs(spark, seed):
    rows = some(400, 6, seed)
    assert found(spark, rows, k=5) == plain(rows, 5)


def test_top_k_over_a_grid_of_many_cells_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk_module, "BLOCK", 16)
    monkeypatch.setattr(topk_module, "TILE", 3)
    monkeypatch.setattr(topk_module, "FAN_IN", 2)
    rows = [(i // 3 * 50, v) if i % 3 == 0 else (i * 50 + 1, v) for i, v in some(300, 4, 5)]
    assert found(spark, rows, k=3, held=20, run=40) == plain(rows, 3)


def test_top_k_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [3.0, 1.0]), (50, None), (100, [None, 1.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [1.0, 2.0, 3.0]),
            (300, []), (350, []), (3, [-0.001, 5.0]), (4, [5.0, -0.001]), (400, [1e6, 1e6]), (7, [3e7, 1.0])]
    assert found(spark, rows) == plain(rows, 5)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []


def test_top_k_counts_exactly_beyond_doubles(spark):
    rows = [(0, [2.0**21, 1 / 256]), (1, [2.0**22, 1 / 256]), (2, [2.0**22, 2 / 256]), (3, [2.0**22 + 1, -1.0])]
    assert found(spark, rows) == plain(rows, 5)
    with pytest.raises(Exception, match="does not fit a long"):
        found(spark, [(0, [2.0**40]), (1, [2.0**40])])


def whitened(spark, rows, **options):
    return whiten(table(spark, rows), **options).toPandas()


def check_white(pandas, rows, k):
    """Against numpy's eigenvectors of the distinct vectors' covariance."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    n, total, x = len(fit), fit.astype(object).sum(axis=0), np.array([v for _, v in kept])
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(pandas) == len(kept) * k and set(pandas["n"]) == {n}
    assert abs(pandas["identity_error"].iloc[0]) < 1e-8
    for c in range(k):
        own = pandas[pandas.component == c + 1]
        want = {}
        for (i, v), w in zip(kept, (x - fit.mean(axis=0)) @ axes[:, c] / math.sqrt(values[c]), strict=True):
            want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(v, total, strict=True)), w))
        signs = {1.0, -1.0}
        for i, dev, w in zip(own["vec_id"], own["deviation"], own["whitened"], strict=True):
            choices = [b for a, b in want[None if i != i else i] if a == int(dev)]
            assert choices
            signs &= {s for s in signs if any(abs(s * w - b) < 1e-7 for b in choices)}
        assert signs
        assert np.allclose(own["explained"], values[c] / values.sum(), rtol=1e-8)


def test_whitening_equals_numpy_when_passes_find_it(spark, monkeypatch):
    monkeypatch.setattr(whitening_module, "PASSES", 12)
    r = np.random.default_rng(3)
    scales = np.array([40, 20, 9, 4] + [0.05] * 20)
    rows = [(i, (r.normal(size=24) * scales).tolist()) for i in range(300)]
    spied = []
    real = whitening_module._times
    monkeypatch.setattr(whitening_module, "_times", lambda *a: spied.append(a[2].shape) or real(*a))
    check_white(whitened(spark, rows), rows, 4)
    assert all(s == (24, 12) for s in spied)


def test_whitening_takes_the_whole_space_when_residuals_fail(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=30).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    spied = []
    real = whitening_module._times
    monkeypatch.setattr(whitening_module, "_times", lambda *a: spied.append(a[2].shape) or real(*a))
    check_white(whitened(spark, rows), rows, 4)
    assert spied[-1] == (30, 30) and len(spied) == whitening_module.PASSES + 1


def test_whitening_of_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [2.0, -1.0]), (None, [0.25, 3.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [-0.0, 0.0])]
    check_white(whitened(spark, rows), rows, 2)
    assert whitened(spark, []).empty
    assert whitened(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])]).empty
    assert whitened(spark, [(1, [])]).empty
    assert list(whitened(spark, [(1, [1.0, 5.0]), (2, [1.0, 7.0])])["component"]) == [1, 1]
    with pytest.raises(ValueError, match="different lengths"):
        whitened(spark, [(1, [1.0]), (2, [1.0, 2.0])])


def test_deviations_are_exact_beyond_a_long(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 2.0**33])]
    got = whitened(spark, rows, k=1)
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert [int(d) for d in got.sort_values("vec_id")["deviation"]] == [sum((3 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
