"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from ledgerlens.llm import queries, whitening


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    x = rng.standard_normal((n, d)) * 0.9 ** np.arange(d) @ turn + rng.standard_normal(d)
    return x.astype(np.float32)


def dense(x):
    whole = [[int(np.floor(1024 * float(c))) + 100_000 for c in row] for row in x]
    n = len(whole)
    sums = [sum(c) for c in zip(*whole)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in whole]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in whole])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("n,d", [(400, 64), (300, 130), (200, 12), (60, 3)])
def test_same_as_dense(spark, n, d):
    x = vectors(n, n, d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(-1, None), (-2, []), (-3, [None] * d), (-4, [float("nan")] * d), (-5, [float("inf")] * d),
           (-6, [1.0] * (d + 1)), (-7, [1e30] * d)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(whitening.whiten(df, keep=["vec_id"]).collect())
    count, deviation, centred, e, u = dense(x)
    k = min(d, 8)
    assert [r["vec_id"] for r in got] == list(range(n))
    assert [int(r["white"]["deviation"]) for r in got] == deviation
    assert {r["white"]["n"] for r in got} == {count}
    white = np.array([r["white"]["whitened"] for r in got])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    want *= np.sign((white * want).sum(axis=0))
    assert np.abs(white - want).max() < 1e-9
    explained = np.array([r["white"]["explained"] for r in got])
    assert np.abs(explained / (e[:k] / e.sum()) - 1).max() < 1e-10
    assert {r["white"]["identity_error"] < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("spectrum", ["near", "steep", "equal", "low rank"])
def test_residuals_reach_double_precision(spectrum):
    rng, d = np.random.default_rng(1), 120
    e = {"near": 1 + 1e-4 * np.arange(d), "steep": 0.3 ** np.arange(d), "equal": np.repeat([3.0, 1.0], d // 2),
         "low rank": np.append([5.0, 4.0, 3.0], np.zeros(d - 3))}[spectrum]
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    a = (turn * e) @ turn.T
    products = []

    def product(u):
        products.append(u.shape[1])
        return a @ u

    values, u, residuals = whitening.leading_eigenpairs(product, d, 8)
    assert residuals.max() <= 120 * whitening.EPS * values[0] * 2
    assert np.abs(values - np.sort(e)[::-1][:8]).max() < 1e-12 * e.max()
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-12
    assert len(products) < 400


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ whitening.minres(lambda x: a @ x, b, 60, 1e-12) - b).max() < 1e-8


def test_edge_rows(spark):
    schema = "vec_id long, embedding array<double>, white int"
    same = spark.createDataFrame([(None, [1.0, 2.0], 1)] * 3 + [(4, None, 2)], schema)
    got = whitening.whiten(same).collect()
    assert [(r["vec_id"], r["white"]["n"], int(r["white"]["deviation"]), r["white"]["whitened"],
             r["white"]["explained"], r["white"]["identity_error"]) for r in got] == [
        (None, 3, 0, [None, None], [None, None], None)] * 3
    assert got[0].asDict().keys() == {"vec_id", "embedding", "white"}
    assert whitening.whiten(same.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 5.0])], "vec_id long, embedding array<double>")
    n, deviation, *_ = dense(np.array([[1e9, 0.0], [-1e9, 5.0]]))
    assert [int(r["white"]["deviation"]) for r in whitening.whiten(far).orderBy("vec_id").collect()] == deviation


def test_query(spark, tmp_path):
    x = vectors(5, 50, 20)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = queries.op13(spark, str(tmp_path))
    assert got.count() == 400
    assert [f.simpleString() for f in got.schema] == [
        "vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double",
        "explained:double", "identity_error:double"]
    assert {r["component"] for r in got.collect()} == set(range(1, 9))
