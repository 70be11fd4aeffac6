"""The ingest as incremental streams over the raw log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import col
from ..operators.validation import valid_rows
from ..schemas import RAW
from ..sources.parted_table import PartedTable


def raw_stream(spark: SparkSession, folder: str, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.json(folder)
    return rows.withColumns(
        {"published": col("published").try_cast("timestamp"), "logged_ts": F.try_to_timestamp("logged_at")}
    )


def ingest_stream(
    spark: SparkSession, folder: str, table: str, checkpoint: str, *, files_per_batch: int | None = None
) -> StreamingQuery:
    """Merge new files of the log into the article table: the row logged last wins.

    The merge only lets later rows replace earlier ones, so files that come late or twice change nothing, and a batch
    costs its own size: it is appended to the table, which merges its batches on read.
    """
    articles = PartedTable(spark, table)

    def merge(batch: DataFrame, _: int) -> None:
        rows = valid_rows(batch.drop("matched_entities", "run_id", "logged_at"))
        articles.append(rows, order=[col("logged_ts").desc_nulls_last()], stamp="logged_ts")

    stream = raw_stream(spark, folder, files_per_batch=files_per_batch)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """Rows and approximate distinct links per day and source; later rows than the watermark are dropped."""
    windowed = stream.withWatermark("logged_ts", lateness).groupBy(F.window("logged_ts", "1 day"), "source")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("link").alias("links"))


def daily_counts_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each finished day of :func:`daily_counts` to a Parquet folder."""
    rows = daily_counts(stream).select(F.to_date("window.start").alias("day"), "source", "n", "links")
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", folder)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_batch(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Rows and distinct links per day and source, however late a row comes.

    Each micro-batch writes its own partial counts, with a sketch of the links, under its number; a batch that runs again
    writes the same folder again. :func:`read_counts` adds them up, so nothing is held in state and no row is behind a
    watermark.
    """

    def write(batch: DataFrame, number: int) -> None:
        day = F.to_date("logged_ts").alias("day")
        parts = batch.groupBy(day, "source").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("link").alias("links"))
        parts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``day, source, n, links`` of all batches so far; ``links`` is an estimate."""
    parts = spark.read.schema("day date, source string, n bigint, links binary").parquet(folder)
    links = F.hll_sketch_estimate(F.hll_union_agg("links")).alias("links")
    return parts.groupBy("day", "source").agg(F.sum("n").alias("n"), links)
