"""Whitening against a plain eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gazette.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=8):
    """(n, deviations, whitened, explained) by numpy, of whole vectors of one length."""
    c = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x = np.floor(1024 * c).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    d = x - total / n
    cov = d.T @ d / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x.astype(object) - total) ** 2).sum(axis=1), d @ vectors / np.sqrt(e), e / np.trace(cov)


def test_against_plain_numbers(spark):
    rng = np.random.RandomState(1)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(200)]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11)]
    got = whitening.whiten(frame(spark, rows + bad)).toPandas()
    n, deviation, w, explained = plain(rows)
    assert set(got.vec_id) == set(range(200)) and len(got) == 8 * 200 and (got.n == n).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * w).sum(axis=0))
    assert np.allclose(table * sign, w, atol=1e-9)
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-12)
    assert 0 <= got.identity_error.iloc[0] < 1e-9 and got.identity_error.nunique() == 1


def test_defined_cases(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # A null and a repeated identifier, an empty and a short vector; one direction only.
    got = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (3, [2.0, 4.0]), (3, [2.0, 4.0]), (4, []), (5, [3.0])])).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got if r.vec_id is not None) == sorted((False, i, c) for i in (3, 3, 4, 5) for c in (1, 2))
    assert sum(r.vec_id is None for r in got) == 2
    # Entries that are far too large stay whole numbers; their deviations go beyond 64 bits.
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert all(math.isfinite(r.whitened) and r.identity_error < 1e-4 for r in huge) and {r.deviation for r in huge if r.vec_id < 3} == {None}


@pytest.mark.parametrize("d", [1, 2, 9, 40])
def test_contour_finds_what_inertia_counts(d):
    rng = np.random.RandomState(d)
    wide = rng.normal(size=(d, d + 3))
    for v in (wide @ wide.T, np.eye(d) * 5, wide[:, :2] @ wide[:, :2].T, (wide * np.logspace(0, -5, d)[:, None]) @ (wide * np.logspace(0, -5, d)[:, None]).T):
        values, vectors = whitening.leading(v, 8)
        want = np.linalg.eigvalsh(v)[::-1]
        m = min(8, int((want > 1e-12 * want[0]).sum()))
        assert len(values) == m and np.allclose(values, want[:m], rtol=1e-9)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-11


def test_sums_of_products_are_exact():
    rng = np.random.RandomState(3)
    for high in (1 << 10, 1 << 41):
        z = rng.randint(-high, high, size=(100, 5))
        assert (whitening.gram(z) == z.astype(object).T @ z.astype(object)).all()


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()]
    _, deviation, w, explained = plain(rows)
    got = whitening.whiten(df).toPandas()
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(table), np.abs(w), atol=1e-8)
    assert got[got.component == 2].sort_values("vec_id").deviation.tolist() == deviation.tolist()
