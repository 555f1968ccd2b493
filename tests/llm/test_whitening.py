import math
import os

import numpy as np
import pytest

from skyframe.llm import whitening
from skyframe.llm.common import table


def brute(vectors):
    """By the covariance itself: n, deviations, eigenvalues, eigenvectors, trace."""
    x = [[math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    f = np.array(y, float) / n
    v = f.T @ f / n
    e, u = np.linalg.eigh(v)
    return n, [sum(a * a for a in r) for r in y], e[::-1], u[:, ::-1], np.trace(v), f


def check(got, ids, vectors, k):
    n, dev, e, u, trace, f = brute(vectors)
    k = min(k, len(e))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(ids)
    for c in range(1, k + 1):
        z = f @ u[:, c - 1] / math.sqrt(e[c - 1])
        own = np.array([by[i][c]["whitened"] for i in ids])
        assert np.abs(own - z).max() < 1e-6 or np.abs(own + z).max() < 1e-6
    for i, d in zip(ids, dev, strict=True):
        assert len(by[i]) == k
        for c, r in by[i].items():
            assert (r["n"], r["deviation"]) == (n, d)
            assert abs(r["explained"] / (e[c - 1] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def rows(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("n, d, k", [(40, 5, 3), (200, 12, 12), (60, 90, 32)])
def test_same_as_by_the_covariance(spark, n, d, k):
    v = np.random.default_rng(n).normal(size=(n, d)) * np.linspace(3, 0.5, d)
    v = v.astype(np.float32).astype(float).tolist()
    if n > d:
        check(whitening.whiten(rows(spark, v), k).collect(), list(range(n)), v, k)
    else:
        got = whitening.whiten(rows(spark, v), k).collect()
        assert {r["component"] for r in got} == set(range(1, k + 1)) and max(r["identity_error"] for r in got) < 1e-9


def test_many_dimensions_with_restarts(spark):
    """A block that is far smaller than the dimension, and close eigenvalues."""
    v = np.random.default_rng(5).normal(size=(900, 160)).astype(np.float32).astype(float).tolist()
    df = rows(spark, v)
    n, s = whitening.sums(df, "embedding")
    e, x, residual, trace = whitening.components(df, "embedding", n, s, 4, spare=2, most=24)
    _, _, want, u, whole, _ = brute(v)
    assert np.allclose(e, want[:4], rtol=1e-10) and math.isclose(trace, whole, rel_tol=1e-10)
    assert np.allclose(np.abs((x * u[:, :4]).sum(0)), 1, atol=1e-9) and residual.max() <= 1e-12 * e[0]


def test_bad_vectors_go(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 2.0], [2.0, -1.0], None, [1.0, None], [nan, 1.0], [inf, 0.0], [], [0.5, 0.25], [1.0, 2.0, 3.0], [1.0, 2.0]]
    big = 2**60 + 1
    ids = [big, 1, 2, 3, 4, 5, 6, None, 8, 9]
    got = whitening.whiten(rows(spark, v, ids).selectExpr("*", "1 as n", "'x' as whitened")).collect()
    assert {r["vec_id"] for r in got} == {big, 1, None, 9} and len(got) == 8
    n, dev, *_ = brute([v[0], v[1], v[7], v[9]])
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(zip([big, 1, None, 9], dev, strict=True))


def test_without_variance_and_empty(spark):
    assert whitening.whiten(rows(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitening.whiten(rows(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whiten(rows(spark, [], [])).count() == 0
    flat = whitening.whiten(rows(spark, [[float(i), 3.0] for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1}


def test_entries_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e25, 0.0]), (2, [-1e25, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r["deviation"] for r in got} == {None} and {abs(round(r["whitened"], 6)) for r in got if r["component"] == 1} == {1.0}


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    have = table(spark, sf, "embeddings").collect()
    check(whitening.op12_whitening(spark, sf).collect(), [r["vec_id"] for r in have], [r["embedding"] for r in have], 32)
