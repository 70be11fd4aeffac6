"""The stored inverted index: batches of additions by key, merged on read and compacted by ordinary writes.

Each batch adds folders and changes none:

- ``documents/batch=N/slot=S``: the words of each document of the batch and their number, by hash of the key;
- ``postings/batch=N/bucket=B``: one row per word with the length of its document, by hash of the first character of
  the term. Each file holds the words of some documents sorted by term, so that words and prefixes both read few pages
  of it, a batch writes its words where it reads them, and a frequent term lies in many files;
- ``gone/batch=N``: the stored keys that the batch replaces or deletes;
- ``terms/batch=N/bucket=B`` and ``totals/batch=N``: what the batch changes in the documents and occurrences of
  terms, and in the number of documents and words;
- ``done/batch=N`` or ``whole/batch=N``: written last. A batch without it is never read; a whole one stands for all
  before it.

A posting counts unless its key is gone in a later batch. A search reads the buckets of its terms, within their least
and greatest term, and the sums of ``terms`` and ``totals``; it never reads documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import search as ops
from .tables import delete_folder, list_names, newest_per_key, require_key

_WORDS = "fields array<struct<field: string, words: array<string>>>"
_SCHEMAS = {
    "documents": f"doc_key string, length bigint, {_WORDS}, batch int, slot int",
    "postings": "term string, doc_key string, field string, position int, length bigint, batch int, bucket int",
    "gone": "doc_key string, batch int",
    "terms": "term string, documents bigint, occurrences bigint, batch int, bucket int",
    "totals": "documents bigint, words bigint, batch int",
}
_LAST = chr(0x10FFFF)
#: Bytes of stored documents whose words one task sorts: some five million words, which need no spilling.
_SORTED = 16 << 20


def _unique(documents: DataFrame) -> DataFrame:
    """One row per key; of several, the last in the order of their texts."""
    fields = [f for f in ops.FIELDS if f in documents.columns]
    return newest_per_key(require_key(documents, "doc_key"), "doc_key", *[col(f).desc_nulls_last() for f in fields])


class SearchIndex:
    """The index below a folder that all executors share. One writer at a time.

    ``parts`` is the number of buckets and of slots, and stays the same for the life of an index.
    """

    def __init__(self, spark: SparkSession, root: str, *, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.encode(F.substring("term", 1, 1), "UTF-8")), F.lit(self.parts)).cast("int")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("doc_key"), F.lit(self.parts)).cast("int")

    # Batches

    def batches(self) -> list[int]:
        """The batches that count, in order: the newest whole one and all after it."""
        found = {kind: self._numbers(kind) for kind in ("whole", "done")}
        first = max(found["whole"], default=0)
        return sorted({n for n in (*found["whole"], *found["done"]) if n >= first})

    def _numbers(self, kind: str) -> list[int]:
        names = [re.fullmatch(r"batch=(\d+)", n) for n in list_names(self.spark, f"{self.root}/{kind}")]
        return [int(m.group(1)) for m in names if m and "_SUCCESS" in list_names(self.spark, f"{self.root}/{kind}/{m.group(0)}")]

    def _next(self) -> int:
        """A number that no batch has begun to use."""
        begun = [int(n[6:]) for kind in _SCHEMAS for n in list_names(self.spark, f"{self.root}/{kind}") if re.fullmatch(r"batch=\d+", n)]
        return max(begun, default=0) + 1

    def _table(self, kind: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/batch={n}" for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[kind])
        return self.spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def _write(self, rows: DataFrame, kind: str, number: int, *parts: str) -> None:
        # Rows of a part come together first, so a batch adds few files; a large part fills several.
        rows = rows.hint("rebalance", *parts) if parts and kind != "postings" else rows
        # Row groups of documents are the parts in which their words are read.
        writer = rows.write.mode("error").option("parquet.block.size", _SORTED if kind == "documents" else 128 << 20)
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.root}/{kind}/batch={number}")

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{self.root}/{kind}").parquet(f"{self.root}/{kind}/batch={number}")

    # Changes

    def upsert(self, documents: DataFrame) -> int:
        """Add documents (``doc_key`` and any of the fields), replacing stored ones of the same key; the batch's number."""
        number = self._next()
        rows = _unique(documents)
        rows = rows.select("doc_key", ops.field_words(rows).alias("fields"))
        words = F.aggregate("fields", F.lit(0).cast("bigint"), lambda n, f: n + F.size(f["words"]))
        rows = rows.select("doc_key", words.alias("length"), "fields", self._slot().alias("slot"))
        self._write(rows, "documents", number, "slot")
        return self._finish(number, self._read("documents", number).select("doc_key"))

    def delete(self, keys: DataFrame) -> int:
        """Remove the documents with these keys (``doc_key``); the batch's number."""
        number = self._next()
        self._write(self.spark.createDataFrame([], "doc_key string, length bigint, " + _WORDS + ", slot int"), "documents", number, "slot")
        return self._finish(number, keys.select("doc_key").where("doc_key is not null").distinct())

    def _finish(self, number: int, keys: DataFrame) -> int:
        """Everything that follows from the documents of a batch and the keys that it replaces."""
        new = self._read("documents", number)
        # Only the parts in which the keys lie are read; a first batch replaces nothing.
        slots = [r[0] for r in keys.select(self._slot().alias("slot")).distinct().collect()] if self.batches() else []
        stored = self.documents().where(col("slot").isin(slots)) if slots else self.documents().limit(0)
        old = stored.join(keys, "doc_key", "left_semi")
        self._write(old.select("doc_key"), "gone", number)
        self._write_postings(new, number)
        gone = self._read("gone", number).select("doc_key")
        old = stored.join(gone, "doc_key", "left_semi")
        signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        self._write(_term_counts(signed).withColumn("bucket", self._bucket()), "terms", number, "bucket")
        sums = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"), F.coalesce(F.sum(col("sign") * col("length")), F.lit(0)).alias("words"))
        self._write(sums, "totals", number)
        self.spark.range(1).coalesce(1).write.mode("error").parquet(f"{self.root}/done/batch={number}")
        return number

    def _write_postings(self, documents: DataFrame, number: int) -> None:
        places = ops.word_places(documents, "length").withColumn("bucket", self._bucket())
        # Each task sorts the words of its own documents, so none is moved, and reads no more of them than it can sort.
        most = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(most)
        self.spark.conf.set(most, _SORTED)
        try:
            self._write(places.sortWithinPartitions("bucket", "term"), "postings", number, "bucket")
        finally:
            self.spark.conf.set(most, before)

    def compact(self) -> int:
        """Write what counts as one batch, which then stands for all before it, and delete those."""
        before = self.batches()
        number = self._next()
        rows = self.documents().drop("batch")
        self._write(rows, "documents", number, "slot")
        self._write(self.spark.createDataFrame([], "doc_key string"), "gone", number)
        self._write_postings(self._read("documents", number), number)
        self._write(self.terms().withColumn("bucket", self._bucket()), "terms", number, "bucket")
        self._write(self._sums(), "totals", number)
        self.spark.range(1).coalesce(1).write.mode("error").parquet(f"{self.root}/whole/batch={number}")
        for old in before:
            for kind in (*_SCHEMAS, "done", "whole"):
                delete_folder(self.spark, f"{self.root}/{kind}/batch={old}")
        return number

    # Reading

    def _alive(self, rows: DataFrame) -> DataFrame:
        gone = self._table("gone").select(col("doc_key").alias("_key"), col("batch").alias("_batch"))
        return rows.join(gone, (col("doc_key") == col("_key")) & (col("batch") < col("_batch")), "left_anti")

    def documents(self) -> DataFrame:
        """``doc_key, length, fields, batch, slot`` of all documents."""
        return self._alive(self._table("documents"))

    def postings(self, clauses: DataFrame | None = None) -> DataFrame:
        """``term, doc_key, field, position, length``; with clauses, of the parts in which their terms lie."""
        rows = self._alive(self._within(self._table("postings"), clauses))
        return rows.select("term", "doc_key", "field", "position", "length")

    def terms(self, clauses: DataFrame | None = None) -> DataFrame:
        """``term, documents, occurrences`` of the terms that documents have."""
        rows = self._within(self._table("terms"), clauses)
        sums = rows.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))
        return sums.where("documents > 0")

    def _sums(self) -> DataFrame:
        return self._table("totals").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))

    def corpus(self) -> DataFrame:
        """One row: the number of documents and their mean length."""
        return self._sums().select(col("documents").alias("n"), F.try_divide("words", "documents").alias("mean"))

    def _within(self, rows: DataFrame, clauses: DataFrame | None) -> DataFrame:
        """Only the buckets of the clauses, each from its least to its greatest term: at most ``parts`` ranges."""
        if clauses is None:
            return rows
        high = F.when(col("is_prefix"), F.concat("term", F.lit(_LAST))).otherwise(col("term"))
        ranges = clauses.groupBy(self._bucket().alias("bucket")).agg(F.min("term").alias("low"), F.max(high).alias("high")).collect()
        wanted = F.lit(False)
        for r in ranges:
            wanted = wanted | ((col("bucket") == r.bucket) & col("term").between(r.low, r.high))
        return rows.where(col("bucket").isin([r.bucket for r in ranges])).where(wanted) if ranges else rows.limit(0)

    # Searches

    def search(self, queries: DataFrame, *, limit: int = 50) -> DataFrame:
        """``query_id, doc_key, rank`` in the order of the keys."""
        parsed = ops.parse_batch(queries)
        return ops.search_parsed(self.postings(ops.query_clauses(parsed)), parsed, limit=limit)

    def scored(self, queries: DataFrame) -> DataFrame:
        """``query_id, doc_key, score`` of all matching documents."""
        parsed = ops.parse_batch(queries)
        clauses = ops.query_clauses(parsed)
        return ops.scored_parsed(self.postings(clauses), self.corpus(), parsed, terms=self.terms(clauses))

    def ranked(self, queries: DataFrame, *, limit: int = 50) -> DataFrame:
        """``query_id, doc_key, score, rank``, best first."""
        return ops._top(self.scored(queries), [col("score"), col("doc_key")], limit)

    def snippets(self, hits: DataFrame, documents: DataFrame, queries: DataFrame, *, words: int = 10) -> DataFrame:
        """The hits with the best words of their texts."""
        clauses = ops.query_clauses(ops.parse_batch(queries))
        return ops.snippets(hits, self.postings(clauses), documents, queries, words=words)


def _term_counts(signed: DataFrame) -> DataFrame:
    """``term, documents, occurrences`` that documents with a sign add up to; terms that do not change are left out.

    The words of a document are sorted where it lies, so that the first of each term counts the document, and only sums
    per term are moved.
    """
    words = signed.select("sign", F.sort_array(F.flatten(F.transform("fields", lambda f: f["words"]))).alias("words"))
    listed = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.coalesce(w != F.get("words", i - 1), F.lit(True)).alias("is_first")))
    each = words.select("sign", F.explode(listed).alias("w")).select("sign", "w.*")
    documents = F.sum(F.when(col("is_first"), col("sign")).otherwise(0))
    sums = each.groupBy("term").agg(documents.alias("documents"), F.sum("sign").cast("bigint").alias("occurrences"))
    return sums.where("documents <> 0 or occurrences <> 0")
