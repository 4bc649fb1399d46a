"""Whitening by spectrum slicing against numpy's own eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprobe.llm import spectrum_slicing as ss

SF001 = "/root/testdata/sf0.001"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return q @ np.diag(values) @ q.T


MATRICES = {
    "spread": symmetric(np.linspace(1, 90, 40)), "one": np.array([[3.0]]), "two": symmetric([2.0, 1.0]),
    "ties": symmetric([5.0] * 4 + [3.0] * 3 + [1.0] * 20), "identity": 7 * np.eye(12), "zero": np.zeros((5, 5)),
    "diagonal": np.diag(np.arange(30.0)), "close": symmetric([5, 5 - 1e-9, 5 - 2e-9, 3] + [1.0] * 16),
    "closer": symmetric([5, 5 - 1e-13, 5 - 2e-12, 3] + [1.0] * 16), "graded": symmetric([1e8, 1e-3, 1e-4] + [0.0] * 20),
    "negative": symmetric([-4.0, -1, 0, 0, 2, 9, 9.5, 9.5, 9.6, 10, 30]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading_pairs(name):
    v = MATRICES[name]
    values, vectors = ss.leading_pairs(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    scale = max(np.abs(v).sum(axis=1).max(), 1e-300)
    assert len(values) == min(8, len(v)) and np.abs(values - want).max() <= 1e-14 * scale
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(2)
    for n in range(1, 14):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)) * (rng.random((n, n)) < 0.4)  # many zeros: pivots of both sizes
            a = (a + a.T).astype(float)
            shift = rng.normal()
            assert ss.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
            a[np.diag_indices(n)] = 0
            w = np.linalg.eigvalsh(a)
            if np.abs(w).min() > 1e-6:
                assert ss.inertia(a) == ((w > 0).sum(), (w < 0).sum())


def check(rows, vectors):
    """Rows of the operator for the valid ``vectors`` (lists of doubles) against numpy and exact fractions."""
    dims = max(map(len, vectors))
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dims - len(v)) for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    y = np.array([[float(Fraction(int(c)) - Fraction(int(s), n)) for c, s in zip(r, total, strict=True)] for r in x])
    v = y.T @ y / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(rows) == n * len(values) and set(got) == set(range(n))
    white = np.array([[got[i][k + 1]["whitened"] for k in range(len(values))] for i in range(n)])
    want = y @ basis / np.sqrt(values)
    want = want * np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-6
    error = np.abs(white.T @ white / n - np.outer(white.mean(axis=0), white.mean(axis=0)) - np.eye(len(values))).max()
    assert error < 1e-6
    for i in range(n):
        for k, r in got[i].items():
            assert r["n"] == n and r["deviation"] == sum(int(n * c - s) ** 2 for c, s in zip(x[i], total, strict=True))
            assert abs(r["explained"] - values[k - 1] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9


def test_table_against_numpy(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet")
    kept = [r["embedding"] for r in table.orderBy("vec_id").collect()]
    check(ss.whitening_report(table.repartition(7)).collect(), kept)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist() for _ in range(40)]
    good[3], good[4], good[5], good[6] = good[3][:2], [], [1e3, 0.0, -1e3, 0.5, 0.0], good[7]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf")]), (94, [0.0, -float("inf")])]
    schema = "vec_id long, embedding array<double>, component string, n int, whitened int"
    table = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in [*enumerate(good), *bad]], schema).repartition(3)
    check(ss.whiten(table).collect(), good)
    again = ss.whiten(table.withColumn("vec_id", F.lit(None).cast("long")))
    assert again.count() == 40 * 5 and again.where("vec_id is not null").count() == 0
    for rows in ([], bad, [(1, [])]):
        assert ss.whiten(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], schema)).collect() == []


def test_directions_without_spread(spark):
    """Constant columns and a single row: null, not a division by zero."""
    schema = "vec_id long, embedding array<double>"
    rows = ss.whiten(spark.createDataFrame([(i, [float(i % 3), 4.0, 4.0]) for i in range(9)], schema)).collect()
    assert len(rows) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert all(r["identity_error"] < 1e-12 for r in rows)
    rows = ss.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == [(1, 0, None, None, None)] * 2


def test_values_beyond_a_long(spark):
    centre = ss.Centre(3, [2**41, 5])
    x = np.array([[2**41, 0], [0, 5], [0, 0]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(r, (2**41, 5), strict=True)) for r in x]
    assert centre.deviations(x) == [w if w < 2**63 else None for w in want]
    rows = ss.whiten(spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(4)],
                                           "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 8  # beside a spread of 2^40 the other direction is zero to rounding
    assert all(math.isfinite(r["whitened"]) if r["component"] == 1 else r["whitened"] is None for r in rows)
