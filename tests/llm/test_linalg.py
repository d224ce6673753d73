"""Whitening against a dense decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int"


def dense(rows, k):
    kept = {i: [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit - np.array([s / n for s in sums])).astype(float) if n else np.zeros((0, 1))
    c -= c.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    out = {}
    for i, x in kept.items():
        x = np.array(x, dtype=object)
        far = sum(int(t) ** 2 for t in n * x - sums)
        mine = np.array([float(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out[i] = (n, far, mine @ v / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(c.T @ c / n))
    return out, e


def check(spark, rows, k=16, expect=None):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], SCHEMA)
    grid = whitening.on_grid(df)
    got = whitening.whiten(grid, whitening.fit(grid, k)).collect()
    want, e = dense(rows, k)
    expect = min(k, len(e)) if expect is None else expect
    assert len(got) == len(want) * expect
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        n, far, y, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, far)
        assert abs(r.explained - share[r.component - 1]) <= 1e-6 * share[r.component - 1]
        assert r.identity_error <= 1e-9
    return by, want, e


def test_as_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 24)) * np.linspace(3, 0.1, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(m)]
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (1001, None), (1002, [None] + rows[1][1][1:]), (1003, [float("nan")] + rows[1][1][1:]), (1004, [float("inf")] + rows[1][1][1:]), (1005, []), (None, rows[2][1])]
    want_rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], SCHEMA).repartition(7)
    grid = whitening.on_grid(df)
    got = whitening.whiten(grid, whitening.fit(grid, 16)).collect()
    want, _ = dense(want_rows, 16)
    assert len(got) == (300 + 2 + 1) * 16
    signs = {}
    for r in got:
        if r.vec_id is None:
            continue
        n, far, y, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, far)
        k = r.component - 1
        if abs(y[k]) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(y[k]) == np.sign(r.whitened))
        assert abs(abs(r.whitened) - abs(y[k])) < 1e-8 and abs(r.explained - share[k]) < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_equal_and_absent_variances(spark):
    """Equal eigenvalues show in fresh starts; directions without variance are no components."""
    axes = np.eye(6)
    rows = [(2 * i + s, [float(c) for c in x * (2 * s - 1)]) for i, x in enumerate(axes[:4]) for s in (0, 1)]
    by, want, e = check(spark, rows, expect=4)
    assert np.allclose(e[:4], e[0])
    y = np.array([[next(r.whitened for r in by[k] if r.vec_id == i) for k in range(1, 5)] for i in want])
    assert np.allclose(y.T @ y / len(y), np.eye(4), atol=1e-9)


def test_long_vectors_of_low_rank(spark):
    """Ends before as many steps as a row is long."""
    rng = np.random.default_rng(2)
    m = np.floor(rng.standard_normal((60, 4)) * 50) @ np.floor(rng.standard_normal((4, 200)) * 3)
    check(spark, [(i, [float(c) for c in x]) for i, x in enumerate(m)], k=3, expect=3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    grid = whitening.on_grid(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = whitening.whiten(grid, whitening.fit(grid))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0])]
    grid = whitening.on_grid(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = {r.vec_id: r.deviation for r in whitening.whiten(grid, whitening.fit(grid)).where(F.col("component") == 1).collect()}
    assert got[1] is None and got[3] == dense(rows, 2)[0][3][1]


def test_lengths_must_agree(spark):
    grid = whitening.on_grid(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))
    with pytest.raises(ValueError):
        whitening.fit(grid)
