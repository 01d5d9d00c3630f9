"""op11 against numpy's eigensolver, on the given vectors and on an awkward table."""

import math

import numpy as np
import pytest

from chirpflow.llm import whitening as w

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """vec_id -> integer vector, and the whole spectrum, by dense linear algebra."""
    sound = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in sound], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    white = (x - s / n) @ axes[:, :components] / np.sqrt(values[:components])
    return [i for i, _ in sound], n, ((n * x - s) ** 2).sum(axis=1).tolist(), white, values


def check(rows, got, components=4):
    ids, n, dev, white, values = brute(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, components + 1))
    for c, part in by.items():
        want = sorted(zip([-1 if i is None else i for i in ids], dev, white[:, c - 1].tolist(), strict=True))
        have = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], r["whitened"]) for r in part)
        assert [x[:2] for x in want] == [x[:2] for x in have]
        a, b = np.array([x[2] for x in want]), np.array([x[2] for x in have])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert {r["n"] for r in part} == {n}
        assert all(abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in part)


def test_whitening_equals_dense_solver(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, [r.asDict() for r in w.op11_whitening(spark, SF).collect()])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [math.nan] * 6), (54, [math.inf] * 6)]
    rows += [(60, [-0.0] * 6), (61, [0.0] * 6), (62, [200.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, dim int")
    check(rows, [r.asDict() for r in w.whiten(df).collect()])
    other = spark.createDataFrame([(99, [1.0, 2.0], "x", 1)], df.schema)
    assert w.whiten(df.unionAll(other)).count() == w.whiten(df).count()
    assert w.whiten(df.where("false")).collect() == []


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 3, [[1.0]], [[0.0, 0.0, 0.0]]])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>")
    got = w.whiten(df).collect()
    assert len(got) == len(vectors) * min(4, len(vectors[0]))
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in got)


def test_whitening_low_rank_and_huge_entries(spark):
    rows = [(0, [0.0, 1.0, 5.0]), (1, [1.0, 1.0, 5.0]), (2, [2.0, 1.0, 5.0])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    first = {r["vec_id"]: r for r in got if r["component"] == 1}
    assert abs(first[0]["whitened"]) == pytest.approx(1.5**0.5) and first[0]["explained"] == pytest.approx(1.0)
    assert all(r["whitened"] is None for r in got if r["component"] > 1)
    huge = [(0, [1e30, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 2.0])]
    assert len(w.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<float>")).collect()) == 6


def test_chebyshev_rounds_certify_a_clustered_spectrum():
    """A block narrower than the space, eigenvalues 3 to 5 within 0.1 %."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.concatenate([[9.0, 7.0, 5.005, 5.0, 4.996], np.linspace(4.5, 0.5, 85)])
    matrix = (q * values) @ q.T

    class Dense:
        dim = 90

        def times(self, block):
            return matrix @ block

    got, vectors, residual = w.leading_pairs(Dense(), 4, guard=8)
    assert np.allclose(got, values[:4], rtol=1e-12) and residual < 1e-11
    assert np.abs(np.abs((q[:, :4] * vectors).sum(axis=0)) - 1).max() < 1e-12
