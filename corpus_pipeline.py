"""The corpus pipeline: filter, deduplicate, mix and tokenise ``documents``.

Every stage works on all that the one before kept, and all but the last return the columns of ``documents``. Empty
tables, nulls and repeated rows go through as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gazette.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from gazette.llm.common import documents, stored, table
from gazette.llm.registry import ranks_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 by the toxicity grammar."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document."""
    return exact_dedup.drop_duplicates_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts, one document."""
    return jaccard.one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order; a document that is passed through twice stands there twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded bytes."""
    return bpe.encode_decode(docs, ranks_file(), public_tokenizers.PATTERN, ids=True)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("byte_bpe", tokens)]

#: SQL expresses neither the toxicity grammar nor the merges of the tokenizer; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
