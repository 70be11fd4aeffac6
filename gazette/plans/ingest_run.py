"""One ingest run: feeds to stored, tagged, validated and indexed articles with their report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.search import search_documents
from ..operators.summary import daily_summary, run_statistics, select_sources
from ..operators.tagging import tag_articles
from ..operators.validation import error_rows, valid_rows
from ..session import shared_folder
from ..sources.config import Category, sources_table
from ..sources.feeds import normalise_feeds
from ..sources.raw_log import log_articles
from ..sources.search_index import SearchIndex
from ..sources.parted_table import PartedTable
from ..sources.tables import drop_expired_folders, write_json, write_snapshot
from .quality_report import quality_report, quality_window, write_report


@dataclass(frozen=True)
class Folders:
    """Where a run keeps its tables, all under one shared root."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root}/{name}"


def collect_articles(payloads: DataFrame, sources: DataFrame, *, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised rows and errors of the payloads of the given sources."""
    chosen = sources.select(col("name").alias("source"), "type", "config")
    joined = payloads.drop("type", "config").join(chosen, "source")
    return normalise_feeds(joined, limit=limit)


def ingest_run(
    spark: SparkSession,
    payloads: DataFrame,
    category: Category,
    root: str,
    *,
    as_of: dt.datetime,
    per_source_limit: int | None = None,
    report_limit: int | None = None,
    recent_days: int = 7,
    keep_days: int = 90,
    keep_raw_days: int = 180,
    max_sources: int | None = None,
    excluded: DataFrame | None = None,
    snapshot: bool = False,
    run_id: str | None = None,
) -> dict[str, DataFrame]:
    """Run all steps and return the tables of the run.

    The collected and tagged rows are written once to the shared folder, and everything after reads them.
    """
    folders = Folders(root)
    sources = sources_table(spark, category.sources)
    none = sources.select("name").limit(0)
    chosen = select_sources(sources, excluded if excluded is not None else none, max_sources=max_sources)
    rows, errors = collect_articles(payloads, chosen, limit=per_source_limit)
    rows = rows.drop("position").withColumn("collected_at", F.lit(as_of))
    staged = shared_folder(spark, "collected")
    tag_articles(rows, category.keywords).write.parquet(staged)
    collected = spark.read.parquet(staged)
    failed = shared_folder(spark, "errors")
    errors.write.parquet(failed)
    errors = spark.read.schema(errors.schema).parquet(failed)

    log_articles(collected.drop("matched_entities"), folders.raw, logged_at=as_of, run_id=run_id)
    valid = valid_rows(collected)
    errors = errors.unionByName(error_rows(collected))

    order = [col("published").desc_nulls_last(), col("title"), col("summary")]
    articles = PartedTable(spark, folders.articles)
    articles.upsert(valid, order=order)
    articles.delete_older_than(as_of=as_of, keep_days=keep_days)
    stored = articles.read()

    index = SearchIndex(spark, folders.index)
    index.upsert(search_documents(valid))
    # What has grown too old for the table leaves the index with it.
    index.delete(index.documents().join(search_documents(stored), "doc_key", "left_anti"))

    count = len(category.sources)
    window = quality_window(
        stored,
        valid,
        category=category.name,
        as_of=as_of,
        days=max(recent_days, 14),
        limit=report_limit,
    )
    report = quality_report(
        window, sources, category.quality, as_of=as_of, errors=errors, events_folder=shared_folder(spark, "events")
    )
    write_report(report, folders.reports, as_of=as_of)
    summary = daily_summary(valid, category=category.name)
    write_json(summary, f"{folders.summaries}/run_date={as_of:%Y%m%d}")

    if snapshot:
        write_snapshot(stored, folders.daily, as_of.date())
    drop_expired_folders(spark, folders.raw, today=as_of.date(), keep_days=keep_raw_days)
    drop_expired_folders(spark, folders.daily, today=as_of.date(), keep_days=keep_days)
    statistics = run_statistics(valid, collected, configured_sources=count, window_days=recent_days)
    return report | {"statistics": statistics, "daily_summary": summary, "errors": errors, "articles": stored}
