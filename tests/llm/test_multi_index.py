"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np

from gazette.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, home string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, near=0.95):
    """(vec_id, n_links, component_id, kept) of all rows, by all pairs."""
    width = max((len(v) for _, v in rows if v), default=1)
    fine = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    full = np.array([list(v) + [0.0] * (width - len(v)) if ok else [1.0] * width for (_, v), ok in zip(rows, fine)], dtype=np.float32).astype(float)
    full = full / np.abs(full).max(axis=1, keepdims=True)
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    link = (unit @ unit.T >= near) & np.outer(fine, fine)
    np.fill_diagonal(link, False)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((name, int(link[i].sum()), low, name == low))
    return sorted(out, key=str)


def clusters(seed, n, d, copies):
    rng = np.random.RandomState(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=d)
        for _ in range(copies if k % 5 == 0 else 1):
            rows.append((base + rng.normal(size=d) * 0.18).tolist())
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_links_are_found(spark):
    rows = clusters(1, 300, 16, 6)
    df = frame(spark, rows)
    found = multi_index.near_duplicates(df)
    assert result(found) == plain(rows)
    assert multi_index.recall(df, found, every=3) == 1.0


def test_defined_cases(spark):
    assert multi_index.near_duplicates(frame(spark, [])).count() == 0
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0])]
    assert result(multi_index.near_duplicates(frame(spark, odd))) == plain(odd)
    rows = odd + [(9, [1.0, 2.0]), (9, [1.0, 2.0]), (7, [2.0, 4.0]), (None, [1.0, 2.0]), (11, [1.0]), (12, [2.0, 0.0, 0.0]), (None, [-5.0, 1.0])]
    rows += [(20, [1e-38, 1e-38, 0.0]), (21, [1e38, 1e38, 0.0])]
    assert result(multi_index.near_duplicates(frame(spark, rows))) == plain(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "VISITORS", 32)
    rng = np.random.RandomState(4)
    base = rng.normal(size=16)
    rows = list(enumerate([(base + rng.normal(size=16) * 0.2).tolist() for _ in range(150)] + [rng.normal(size=16).tolist() for _ in range(100)]))
    assert result(multi_index.near_duplicates(frame(spark, rows), target=1.0)) == plain(rows)
    found = multi_index.near_duplicates(frame(spark, rows))
    assert multi_index.recall(frame(spark, rows), found, every=1) >= 0.99


def test_traversal_visits_what_the_bound_allows():
    rng = np.random.RandomState(5)
    rows = rng.normal(size=(400, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = multi_index.MultiIndex(rows, 4000)
    (own_a, far_a), (own_b, far_b) = index.regions(rows)
    home, row, cell = index.place(rows)
    want = {(i, a * index.columns + b) for i in range(400) for a in range(far_a.shape[1]) for b in range(far_b.shape[1]) if far_a[i, a] + far_b[i, b] <= index.bound}
    assert set(zip(row.tolist(), cell.tolist())) == want
    assert all((i, c) in want for i, c in enumerate(home.tolist()))


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(multi_index.near_duplicates(df)) == plain(rows)
