"""FEAST against LAPACK, and the whitening against a dense computation."""
import math

import numpy as np
import pytest

from quarry.llm import queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def matrices(d, rng):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = rng.standard_normal((d, d))
    yield a @ a.T
    yield np.eye(d)
    yield np.outer(a[0], a[0])
    yield (q * np.geomspace(1e6, 1e-6, d)) @ q.T
    yield (q * np.r_[[5.0] * min(3, d), np.linspace(1, 0, max(0, d - 3))]) @ q.T  # a repeated eigenvalue
    close = np.linspace(1, 2, d)
    close[-4:] = 2 + np.arange(min(4, d)) * 1e-9
    yield (q * close) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 5, 64])
def test_feast_finds_the_leading_eigenpairs(d):
    for a in matrices(d, np.random.default_rng(d)):
        e, v = W.feast(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        scale = abs(want).max()
        assert len(e) == min(4, d) and np.abs(e - want).max() <= 1e-13 * scale
        assert np.abs(a @ v - v * e).max() <= 1e-13 * scale
        assert np.abs(v.T @ v - np.eye(len(e))).max() <= 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    tri, e = W.tridiagonal(a), np.linalg.eigvalsh(a)
    for shift in (*np.linspace(-20, 20, 41), *(e + 1e-9), *(e - 1e-9)):
        assert W.count_above(*tri, shift) == (e > shift).sum()


def test_an_eigenvalue_that_is_missed_raises(monkeypatch):
    monkeypatch.setattr(W, "leading_intervals", lambda d, o, k: [(0.9, 1.1, 2)])
    with pytest.raises(ArithmeticError, match="1 were found"):
        W.feast(np.diag([1.0, 0.5, 0.2]), 1)


def dense(rows, k=4):
    """Brute force over (vec_id, vector) with usable vectors of one length."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, r in x:
        r = np.array(r, dtype=object)
        w = (r - s / n).astype(float) @ v[:, :k] / np.sqrt(e[:k])
        out[i] = (n, int(((n * r - s) ** 2).sum()), w, e[:k] / e.sum())
    return out


def check(got, want, k=4):
    assert len(got) == k * len(want)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        at = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        if r.component not in sign and abs(w[at]) > 1e-3:
            sign[r.component] = math.copysign(1, w[at] * r.whitened)
        assert abs(r.whitened - sign.get(r.component, 1) * w[at]) < 1e-8
        assert abs(r.explained - explained[at]) < 1e-10
        assert r.identity_error < 1e-9


def test_whole_table_equals_a_dense_computation(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, sf_small).collect(), dense(rows))


def test_nulls_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_VALUES", 16)
    rng = np.random.default_rng(5)
    good = [(k, [float(c) for c in rng.standard_normal(6)]) for k in range(40)]
    good += [(100 + k, good[k % 3][1]) for k in range(30)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5),
           (204, []), (205, [1.0, 2.0]), (206, [-float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], SCHEMA)
    check(W.whitened(df).collect(), dense(good))
    ids = W.whitened(spark.createDataFrame([(None, v, 1, "x") for _, v in good[:9]] * 2, SCHEMA)).collect()
    assert len(ids) == 18 * 4 and {r.vec_id for r in ids} == {None}


def test_fewer_components(spark):
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 1, "x") for k in range(9)], SCHEMA)
    got = W.whitened(flat).collect()
    assert len(got) == 9 and {r.component for r in got} == {1}
    assert abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-12
    assert W.whitened(flat.where("vec_id = 3")).count() == 0
    assert W.whitened(flat.limit(0)).count() == 0
    assert W.whitened(flat.where("vec_id < 0")).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_null():
    rows, sums = np.array([[3, -4], [1, 2]]), np.array([5, 7], dtype=object)
    assert W._deviation(rows, 10, sums) == [25 ** 2 + 47 ** 2, 5 ** 2 + 13 ** 2]
    assert W._deviation(rows, 10 ** 9, sums) is not None
    assert W._deviation(rows, 10 ** 10, sums) == [None, None]


def test_a_dimension_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(W, "MAX_DIMENSION", 2)
    with pytest.raises(ValueError, match="dimensions"):
        W.whitened(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x")], SCHEMA))
