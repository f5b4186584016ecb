"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from echolens.llm import whitening

ROW = "vec_id long, embedding array<float>, label string, n string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "d") for i, v in rows], ROW)


def _dense(x):
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return centred, values[::-1], vectors[:, ::-1], ((n * x - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize("d, k", ((7, 3), (40, 32)))
def test_whitened(spark, d, k):
    rng = np.random.default_rng(d)
    v = np.float32(rng.standard_normal((300, d)) * np.linspace(0.5, 2, d))
    centred, values, vectors, deviation = _dense(np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000)
    got = whitening.whiten(_frame(spark, enumerate(v)).repartition(5), k).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 300 * k and (got["n"] == 300).all()
    assert (got["deviation"].to_numpy().reshape(300, k) == deviation[:, None]).all()
    w = got["whitened"].to_numpy().reshape(300, k)
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-9
    assert np.abs(w.T @ w / 300 - np.eye(k)).max() < 1e-10
    assert np.allclose(got["explained"].to_numpy()[:k], values[:k] / values.sum(), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


@pytest.mark.parametrize("d, k, rank", ((150, 12, 150), (60, 32, 9), (90, 20, 90)))
def test_eigenpairs(d, k, rank):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, rank)) @ rng.standard_normal((rank, d))
    v = x.T @ x / 500
    jobs = []
    values, vectors, residuals = whitening.eigenpairs(lambda z: jobs.append(z.shape[1]) or v @ z, d, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0] and residuals.max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert len(jobs) < 120


def test_equal_eigenvalues():
    v = np.diag([5.0] * 10 + [2.0] * 30)
    values, vectors, _ = whitening.eigenpairs(lambda z: v @ z, 40, 15)
    assert np.allclose(values, [5.0] * 10 + [2.0] * 5) and np.allclose(vectors.T @ vectors, np.eye(15))


def test_minres_solves():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    shifts = np.array([0.1, -0.3, 7.0])
    t = whitening.minres(lambda z: a @ z, shifts, np.zeros((12, 0)), b, 40, 1e-14)
    for j in range(3):
        assert np.allclose((a - shifts[j] * np.eye(12)) @ t[:, j], b[:, j], atol=1e-8)


def test_odd(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (6, [0.5, 0.25]),
            (7, [0.5, 0.25]), (None, [0.75, 0.25]), (8, [-1.0, 0.5]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(_frame(spark, rows)).toPandas()
    assert sorted(got["vec_id"].dropna()) == [6, 6, 7, 7, 8, 8] and len(got) == 8 and (got["n"] == 4).all()
    assert len(got[got["vec_id"].isna()]) == 2
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(_frame(spark, rows)).count() == 0


def test_rank_one_and_large_sums(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(50)]
    got = whitening.whiten(_frame(spark, rows), shift=10**15).toPandas()
    assert set(got["component"]) == {1} and got["identity_error"].iloc[0] < 1e-10
    assert abs(got["explained"].iloc[0] - 1) < 1e-12
