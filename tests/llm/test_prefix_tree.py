"""The Jaccard join's trees of paths, and the pairs it forms for families that do not link."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from cases import groups
from pyspark.sql import functions as F

from gazette.llm import jaccard


def test_cut_paths_rule_out_no_link():
    rng = random.Random(8)
    for _ in range(300):
        base = rng.sample(range(60), 30)
        whole = []
        for _ in range(12):
            own = set(rng.sample(base, 28)) | set(rng.sample(range(60), rng.randint(0, 4)))
            whole.append(np.array(sorted(own), dtype=np.uint64))
        first = min(int(s[0]) for s in whole)
        whole = [np.unique(np.concatenate(([np.uint64(first)], s))) for s in whole]
        cut = [s[: rng.randint(1, 12)] for s in whole]
        tree = jaccard.PrefixTree(cut[1:], [len(s) for s in whole[1:]], [0] * (len(whole) - 1))
        found = set(tree.linked(cut[0], len(whole[0]), 0))
        links = {i for i, s in enumerate(whole[1:]) if 10 * len(np.intersect1d(whole[0], s)) >= 8 * len(np.union1d(whole[0], s))}
        assert links <= found
        assert set(jaccard.PrefixTree(whole[1:]).linked(whole[0])) == links


def test_blocks_of_a_group_and_own_component():
    path = np.arange(10, dtype=np.uint64)
    tree = jaccard.PrefixTree([path, path, path[:9]], roots=[7, 7, 8])
    assert sorted(tree.linked(path, root=7)) == [2] and sorted(tree.linked(path, root=8)) == [0, 1]


@pytest.mark.parametrize("block", [1024, 7])
def test_pairs_grow_with_the_rows_where_variants_do_not_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    real, pairs = jaccard._links, []

    def counted(found, paths, label):
        pairs.append(found.count())
        return real(found, paths, label)

    monkeypatch.setattr(jaccard, "_links", counted)
    rng, base = random.Random(9), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(60), 2):
            own[at] = f"v{rng.randrange(200)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect())
    assert got == groups(rows)
    assert sum(pairs) <= 2 * len(rows)


def test_a_pair_is_walked_to_by_its_first_shingle_only(spark, monkeypatch):
    real, made = jaccard._walks, spark.sparkContext.accumulator(0)

    def counted(batches):
        for out in real(batches):
            made.add(out.num_rows)
            yield out

    monkeypatch.setattr(jaccard, "_walks", counted)
    rng, base = random.Random(4), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(300), 4):
            own[at] = f"v{rng.randrange(10**6)}x{at}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect())
    assert got == groups(rows)
    assert made.value <= 120 * 119 // 2


def test_few_texts_beside_the_wanted_pass_the_filter(spark):
    every = spark.range(40000).select("id", F.xxhash64("id").alias("key")).unionByName(spark.createDataFrame([(-1, -1), (-2, 0)], "id bigint, key bigint"))
    wanted = every.filter("id % 100 = 0 or id < 0")
    found = {r.id for r in every.filter(jaccard.may_be_among(wanted.select("key"), F.col("key"))).collect()}
    assert {r.id for r in wanted.collect()} <= found and len(found) < 2000
    assert every.filter(jaccard.may_be_among(wanted.select("key").limit(0), F.col("key"))).count() == 0


def test_texts_that_link_with_nothing_are_not_moved(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "may_be_among", lambda keys, column, real=jaccard.may_be_among: seen.append(keys.count()) or real(keys, column))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(300)]
    rows += [(1000 + i, " ".join([f"same{k}" for k in range(40)] + [f"end{i}"])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect())
    assert got == groups(rows) and seen == [5]


@pytest.mark.parametrize("links, tables", [([(9, 1), (1, 8), (7, 1), (3, 3)], 1), ([(i, i + 1) for i in range(60)] + [(80, 70), (70, 90)], 40)])
def test_rounds_end_when_every_set_hangs_on_its_root(spark, monkeypatch, links, tables):
    made = []
    monkeypatch.setattr(jaccard, "stored", lambda df, label, real=jaccard.stored: made.append(label) or real(df, label))
    found = {r.set: r.root for r in jaccard.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert found == {n: r for n, r in root.items() if n != r}
    assert len(made) <= tables
