"""Whitening against plain NumPy, and its odd inputs."""

import math

import numpy as np
import pytest

from gneiss.llm.whitening import deviations, fit_whitening, jacobi, whiten, whitened_digest

KIND = "vec_id long, embedding array<float>"


def plain(rows):
    """(n, sums, covariance) of the distinct grid vectors."""
    x = {tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    m = np.array(sorted(x), float)
    return len(x), m.sum(axis=0), (m - m.mean(axis=0)).T @ (m - m.mean(axis=0)) / len(x)


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_jacobi_finds_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = 10.0 ** -np.arange(d)[:12].repeat(3)[:d]
    values, vectors = jacobi(q * e @ q.T)
    assert np.allclose(values, np.sort(e)[::-1], rtol=1e-3, atol=1e-15)
    assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12)
    scaled = np.diag([1.0, 1e-9]) + np.array([[0, 1e-10], [1e-10, 0]])
    assert jacobi(scaled)[0][1] == pytest.approx(1e-9 - 1e-20, rel=1e-12)


def test_whole_table_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (None, [0.5] * 6)]
    got = whitened_digest(spark.createDataFrame(rows, KIND)).collect()
    n, sums, cov = plain(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 451 * 4 and {r["n"] for r in got} == {n}
    known = dict(rows)
    signs = {}
    for r in got:
        x = np.floor(256 * np.array(known[r["vec_id"]], np.float32).astype(float))
        k = r["component"] - 1
        want = (x - sums / n) @ vectors[:, k] / math.sqrt(values[k])
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-9, abs=1e-9)
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)) == int(r["deviation_exact"])
        assert r["explained"] == pytest.approx(values[k] / cov.trace(), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_odd_tables(spark):
    assert whitened_digest(spark.createDataFrame([], KIND)).collect() == []
    one = whitened_digest(spark.createDataFrame([(1, [0.5, 0.5])] * 3, KIND)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(1, 0, 0.0, 0.0)}
    mixed = whitened_digest(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [-0.0, 1.0])], KIND)).collect()
    assert {(r["dim"], r["n"]) for r in mixed} == {(2, 2), (3, 1)} and len(mixed) == 9
    huge = whitened_digest(spark.createDataFrame([(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [1e30, 0.0])], KIND)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)
    low = whitened_digest(spark.createDataFrame([(1, [1e10, 0.0]), (2, [-1e10, 1.0])], KIND)).collect()
    assert {int(r["deviation_exact"]) for r in low} == {(2 * 2560000000000) ** 2 + 256**2} and {r["deviation"] for r in low} == {None}


def test_general_interface(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5)], "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "whitened long, v array<double>, dim string")
    models = fit_whitening(docs, "v", scale=1e6)
    out = whiten(docs, models, "v", scale=1e6, keep=("whitened", "dim")).collect()
    y = np.array([r[3] for r in out])
    assert y.shape == (200, 5) and np.allclose(np.cov(y.T, bias=True), np.eye(5), atol=1e-9) and out[0][1] == "x"


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    sums = [int(x[:, 0].sum()), int(x[:, 1].sum())]
    assert deviations(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
