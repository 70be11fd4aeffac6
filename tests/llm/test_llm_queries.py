"""Registered queries against their SQL, and the pipeline against plain code, on the smallest given tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from cases import groups, removed, words

import corpus_pipeline
from gazette.llm import bpe, exact_dedup, jaccard, mixing
from gazette.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == names
    assert Counter(map(tuple, got.select(names).collect())) == Counter(found)


def test_whole_tables(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op7_ngram_jaccard"](spark, FOLDER).collect())
    assert got == groups(rows)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op1_substring_dedup"](spark, FOLDER).collect()}
    assert got == {d: (n, n - len(words(kept))) for (d, _), (n, kept) in zip(rows, removed(rows, 13))}


def test_pipeline(spark, docs):
    kept = corpus_pipeline.clean(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum(labels.get(r.doc_id) == 0 and r.doc_id not in left for r in docs.collect()) <= 0.05 * len(labels)
    exact = exact_dedup.drop_duplicates_exact(kept)
    assert Counter("".join(words(r.text)) for r in exact.collect()).most_common(1)[0][1] == 1
    near = jaccard.one_of_each_group(exact)
    roots = {r[2] for r in groups([(r.doc_id, r.text) for r in exact.collect()])}
    assert {r.doc_id for r in near.collect()} == roots
    mixed = mixing.mixed_documents(near)
    assert mixed.columns == docs.columns
    n = bpe.encode_decode(mixed, corpus_pipeline.ranks_file(), corpus_pipeline.public_tokenizers.PATTERN).count()
    assert n == mixed.count() == corpus_pipeline.run(spark, FOLDER).count()
