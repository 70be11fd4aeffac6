"""Append-only log of collected rows as JSON Lines, one folder per day and source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..schemas import RAW
from .tables import list_names, newest_per_key

_STORED = RAW.replace("source string, ", "") + ", log_date string, source string"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def raw_rows(articles: DataFrame, *, logged_at: dt.datetime, run_id: str | None = None) -> DataFrame:
    """Articles in the shape of the log; times become ISO text."""
    entities = col("matched_entities") if "matched_entities" in articles.columns else F.lit(None)
    return articles.select(
        "title",
        "link",
        "summary",
        F.date_format("published", _ISO).alias("published"),
        "source",
        "category",
        entities.cast("map<string,array<string>>").alias("matched_entities"),
        F.lit(logged_at.isoformat()).alias("logged_at"),
        F.lit(run_id).cast("string").alias("run_id"),
    )


def unlogged(rows: DataFrame, logged: DataFrame) -> DataFrame:
    """With a run id: rows whose link that run has not logged for the source yet, each link once."""
    keys = ["run_id", "source", "link"]
    fresh = rows.join(logged.select(*keys), keys, "left_anti")
    once = fresh.withColumn("_key", F.concat_ws("\u0001", *keys))
    return newest_per_key(once, "_key", col("published"), col("title"), col("summary")).drop("_key")


def append_raw(rows: DataFrame, root: str) -> None:
    """Append to ``log_date=…/source=…``; a source with many rows is spread over several files."""
    dated = rows.withColumn("log_date", F.left("logged_at", F.lit(10)))
    spread = dated.hint("rebalance", "log_date", "source")
    spread.write.partitionBy("log_date", "source").mode("append").json(root)


def append_plain(articles: DataFrame, folder: str, *, logged_at: dt.datetime) -> None:
    """Append log lines that keep the source inside, for readers that do not look at folder names."""
    raw_rows(articles, logged_at=logged_at).write.mode("append").json(folder)


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """The log as a table; filters on ``log_date`` and ``source`` prune folders."""
    if not list_names(spark, root):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).json(root)


def read_raw_files(spark: SparkSession, pattern: str) -> DataFrame:
    """A log of plain files ``<day>/<source>.jsonl`` with the day of the folder."""
    rows = spark.read.schema(RAW).json(pattern)
    day = F.regexp_extract(col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return rows.withColumn("log_date", F.try_to_date(F.nullif(day, F.lit(""))))


def log_articles(
    articles: DataFrame, root: str, *, logged_at: dt.datetime, run_id: str | None = None
) -> None:
    """Append the articles; a repeated run with the same id on the same day adds nothing twice."""
    rows = raw_rows(articles, logged_at=logged_at, run_id=run_id)
    if run_id is not None:
        today = read_raw(articles.sparkSession, root).where(col("log_date") == logged_at.date().isoformat())
        rows = unlogged(rows, today.where(col("run_id") == run_id))
    append_raw(rows, root)
