"""Exact duplicates with two passes and a Bloom filter.

Texts are equal when identical after deleting ASCII white space. The first pass reads every text once, keeps its
digest, and counts the filter's slots; slots hit twice or more form the filter. The second pass asks the filter:
a digest with a slot that was hit once is unique and passes straight through; only the others are shuffled.

The filter has a fixed upper size (``FILTER_BITS``), so what is sent to all tasks never grows past it. On a corpus
beyond that size more unique rows are shuffled than needed, and the result stays the same.

Defined cases: a null text counts as empty, empty texts equal each other; a null doc_id comes after all others;
rows equal in doc_id and text are copies of each other; an empty table gives an empty result; columns other than
those named are not read by ``duplicate_groups`` and pass unchanged through ``drop_duplicates_exact``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from gazette.llm.common import bounded_batches, numbered_columns, stored, texts

FILTER_BITS = 1 << 25
BITS_PER_ROW = 16
WHITE = b" \t\n\x0b\x0c\r"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [v or b"" for v in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.sha256(v.translate(None, WHITE)).digest() for v in values], pa.binary()),
                pa.array([len(v.decode("utf-8", "replace")) for v in values], pa.int64()),
            ],
            ["doc_id", "_llm_digest", "_llm_length"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text without white space, and code points of the text; one row per row."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digest, "doc_id bigint, _llm_digest binary, _llm_length bigint")


def _slots(bits: int) -> list[Column]:
    """Two slots of the filter, from different bytes of the digest."""
    parts = [F.conv(F.hex(F.substring("_llm_digest", at, 7)), 16, 10).cast("long") for at in (1, 9)]
    return [F.pmod(p, F.lit(bits)) for p in parts]


def repeated_slots(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter: one bit per slot, set if two rows or more hit it. It has ``bits / 8`` bytes, whatever the input."""
    hits = rows.select(F.explode(F.array_distinct(F.array(*_slots(bits)))).alias("slot")).groupBy("slot").count()
    words = hits.filter("count > 1").groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set")
    )
    table = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table["word"].to_numpy()] = table["set"].to_numpy().view(np.uint64)
    return out


def with_possible(rows: DataFrame, packed: np.ndarray, bits: int) -> DataFrame:
    """``rows`` with ``_llm_possible``: all slots of the digest were hit twice or more."""
    names = rows.columns

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.ones(batch.num_rows, dtype=bool)
            for name in ("_llm_slot_a", "_llm_slot_b"):
                slot = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                found &= (packed[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, "_llm_possible"])

    a, b = _slots(bits)
    schema = StructType([*rows.schema.fields, StructField("_llm_possible", BooleanType())])
    return rows.withColumns({"_llm_slot_a": a, "_llm_slot_b": b}).mapInArrow(test, schema)


def duplicate_groups(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of a group, the row with the longest text stays, then the smallest doc_id; of rows that tie in both, one.
    """
    rows = stored(digests(docs).withColumn("_llm_row", F.monotonically_increasing_id()), "exact-digests")
    need = max(1 << 15, BITS_PER_ROW * rows.count())
    bits = min(filter_bits, 1 << need.bit_length())
    tested = with_possible(rows, repeated_slots(rows, bits), bits)
    alone = tested.filter("not _llm_possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_llm_digest"
    )
    maybe = tested.filter("_llm_possible")
    best = maybe.groupBy("_llm_digest").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("_llm_length")).alias("shorter"), F.col("doc_id").isNull().alias("last"), "doc_id", "_llm_row")).alias("_llm_best"),
    )
    # Written first, so that both sides of the join are shuffled for it and a large group can be split.
    best = stored(best, "exact-groups")
    grouped = maybe.join(best, "_llm_digest").select(
        maybe.doc_id,
        F.col("_llm_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_llm_row") == F.col("_llm_best._llm_row")).alias("kept"),
        "_llm_digest",
    )
    return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("_llm_digest"))).drop("_llm_digest")


def _tagged(columns: list[str]):
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in texts(batch.column(at))]
            digest = pa.array([hashlib.sha256(v.translate(None, WHITE)).digest() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digest], [*columns, "_llm_digest"])

    return run


def drop_duplicates_exact(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows whose digest may be repeated are shuffled, and of those only the ones that stay in their group or
    tie with them carry their text.
    """
    spark, names = docs.sparkSession, docs.columns
    docs = numbered_columns(docs, "doc_id", "text")
    rows = stored(digests(docs), "exact-digests")
    need = max(1 << 15, BITS_PER_ROW * rows.count())
    bits = min(filter_bits, 1 << need.bit_length())
    packed = repeated_slots(rows, bits)
    best = with_possible(rows, packed, bits).filter("_llm_possible").groupBy("_llm_digest").agg(
        F.min(F.struct((-F.col("_llm_length")).alias("shorter"), F.col("doc_id").isNull().alias("last"), "doc_id")).alias("_llm_best")
    )
    bounded_batches(spark)
    schema = StructType([*docs.schema.fields, StructField("_llm_digest", BinaryType())])
    full = docs.mapInArrow(_tagged(docs.columns), schema)
    tested = with_possible(full, packed, bits)
    alone = tested.filter("not _llm_possible").select(*docs.columns)
    length = F.char_length(F.coalesce("text", F.lit("")))
    tied = (
        tested.filter("_llm_possible")
        .join(best, "_llm_digest")
        .filter((length == -F.col("_llm_best.shorter")) & F.col("doc_id").eqNullSafe(F.col("_llm_best.doc_id")))
        .dropDuplicates(["_llm_digest"])
        .select(*docs.columns)
    )
    return alone.unionByName(tied).toDF(*names)
