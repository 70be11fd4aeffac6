"""Quality report: events, source rows, counts and review items, as named tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import quality_checks, source_health
from ..operators.recency import event_time, recent_by_category
from ..operators.signals import build_events
from ..operators.summary import lookback_window
from ..session import shared_folder
from ..sources.config import QualitySettings, backlog_table
from ..sources.tables import write_json


def quality_report(
    articles: DataFrame,
    sources: DataFrame,
    settings: QualitySettings,
    *,
    as_of: dt.datetime,
    errors: DataFrame | None = None,
    events_folder: str | None = None,
) -> dict[str, DataFrame]:
    """Tables ``events, sources, summary, statuses, models, review, backlog``.

    With ``events_folder`` the events are written there first and every section reads them back, so their
    extraction runs once and a lost executor costs a read.
    """
    spark = articles.sparkSession
    events = build_events(articles, sources, settings)
    if events_folder is not None:
        events.write.mode("overwrite").parquet(events_folder)
        events = spark.read.parquet(events_folder)
    counts = source_health.event_counts(events)
    latest = source_health.event_rollup(events)
    rows = source_health.source_rows(
        sources, source_health.article_counts(articles), latest, settings, as_of=as_of, errors=errors
    )
    backlog = backlog_table(spark, settings)
    summary = source_health.event_summary(counts, rows, settings)
    review = source_health.review_items(events, counts, rows, backlog, settings)
    return {
        "events": events,
        "sources": rows,
        "summary": summary,
        "statuses": source_health.status_histogram(rows),
        "models": source_health.model_histogram(counts, settings),
        "review": review,
        "backlog": backlog,
    }


def write_report(report: dict[str, DataFrame], root: str, *, as_of: dt.datetime) -> dict[str, str]:
    """Write every section as JSON for the day, and the same again as the latest; returns both folders."""
    day = as_of.strftime("%Y%m%d")
    for name, table in report.items():
        dated = f"{root}/report_date={day}/{name}"
        write_json(table, dated)
        write_json(table.sparkSession.read.schema(table.schema).json(dated), f"{root}/latest/{name}")
    return {"dated": f"{root}/report_date={day}", "latest": f"{root}/latest"}


def stored_checks(articles: DataFrame, *, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Missing fields, duplicate links and dates of the stored articles."""
    conditions = {n: f"{n} IS NULL OR {n} = ''" for n in ("title", "link", "summary")}
    conditions["published"] = "published IS NULL"
    return {
        "missing": quality_checks.missing_fields(articles, conditions),
        "duplicates": quality_checks.duplicate_link_count(articles),
        "dates": quality_checks.date_check_fallback(articles, as_of=as_of),
    }


def quality_window(stored: DataFrame, current: DataFrame, *, category: str, as_of: dt.datetime, days: int, limit: int | None) -> DataFrame:
    """Recent stored rows, or the rows of this run when there are none."""
    recent = recent_by_category(stored, category, as_of=as_of, days=days, limit=limit)
    return current if recent.isEmpty() else recent


def stored_quality_run(
    articles: DataFrame,
    sources: DataFrame,
    settings: QualitySettings,
    *,
    category: str,
    as_of: dt.datetime,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Report over the stored rows of a category from its look-back window to ``as_of``."""
    spark: SparkSession = articles.sparkSession
    wanted = articles.where(col("category") == category)
    window = lookback_window(wanted, as_of=as_of)
    since = window.select(F.timestamp_add("DAY", -F.max("lookback_days").cast("int"), F.lit(as_of))).scalar()
    recent = wanted.where(event_time() >= since)
    folder = folder or shared_folder(spark, "events")
    report = quality_report(recent, sources, settings, as_of=as_of, events_folder=folder)
    return report | stored_checks(articles, as_of=as_of)
