"""What the operators share: reading, stored intermediate tables, and bounded work inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gazette.session import shared_folder

#: Rows that cross to Python at once, and bytes of text that numpy works on at once (one longer text goes alone).
ROWS_PER_BATCH = 512
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table."""
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Keep Arrow batches small, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it cuts the lineage and survives lost executors.

    Shuffle files of the finished write are of no further use, so they go with it.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    path = f"{shared_folder(spark, label)}/table"
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def chunks(values: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``limit`` bytes together."""
    first = size = 0
    for i, value in enumerate(values):
        n = len(value or b"")
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if values:
        yield first, len(values)


def numbered_columns(docs: DataFrame, *known: str) -> DataFrame:
    """``docs`` with all columns but ``known`` named by their place, so that no name of an operator's own can clash."""
    return docs.toDF(*(name if name in known else f"column_{i}" for i, name in enumerate(docs.columns)))
