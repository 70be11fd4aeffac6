"""Counts, trends and summaries over the article table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, col
from ..schemas import ENTITY_MAP
from .recency import event_time
from .tagging import entity_rows


def source_totals(articles: DataFrame) -> DataFrame:
    """Rows per source and, in the same job, over all sources (``is_total``)."""
    grouped = articles.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    marked = grouped.select("source", "n", (col("level") > 0).alias("is_total"))
    return marked.orderBy(col("is_total").desc(), col("n").desc(), col("source"))


def top_trends(articles: DataFrame, *, as_of: dt.datetime, days: int = 7, limit: int = 10) -> DataFrame:
    """Entities by number of matched keywords in the window, from JSON text; unreadable values are passed over."""
    recent = articles.where(col("collected_at") >= F.lit(as_of - dt.timedelta(days=days)))
    # Values that are no lists must not spoil the other entities, so they are read as text first.
    parsed = F.from_json("entities_json", "map<string,string>")
    entries = recent.select(F.explode_outer(parsed).alias("entity", "listed"))
    sizes = entries.where(col("listed").startswith("[")).select("entity", F.json_array_length("listed").alias("n"))
    totals = sizes.groupBy("entity").agg(F.sum("n").cast("bigint").alias("n"))
    return totals.orderBy(col("n").desc(), col("entity")).limit(max(limit, 0))


def run_statistics(valid: DataFrame, collected: DataFrame, *, configured_sources: int, window_days: int) -> DataFrame:
    """One row: valid, matched and collected rows and the sources seen."""
    matched = F.size("matched_entities") > 0
    before = collected.agg(
        F.struct(F.count(F.lit(1)).alias("collected"), F.count_if(matched).alias("collected_matched")).alias("c")
    )
    row = valid.agg(
        F.count(F.lit(1)).alias("article_count"),
        F.countDistinct(blank_to_null("source")).alias("source_count"),
        F.count_if(matched).alias("matched_count"),
    )
    return row.withColumn("c", before.scalar()).select(
        "article_count",
        "source_count",
        "matched_count",
        F.lit(configured_sources).cast("bigint").alias("sources"),
        "c.collected",
        "c.collected_matched",
        col("article_count").alias("validated"),
        F.lit(window_days).cast("bigint").alias("window_days"),
    )


def daily_entities(tagged: DataFrame) -> DataFrame:
    """Matched keywords per day and entity."""
    exploded = entity_rows(tagged, F.to_date(event_time()).alias("day"))
    return exploded.groupBy("day", "entity").agg(F.sum(F.size("keywords")).cast("bigint").alias("n"))


def daily_sources(tagged: DataFrame) -> DataFrame:
    """Rows and rows with a match per day and source."""
    return tagged.groupBy(F.to_date(event_time()).alias("day"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("matched_entities") > 0).alias("matched")
    )


def daily_summary(tagged: DataFrame, *, category: str) -> DataFrame:
    """One document per day: counts, entities by matches descending, rows per source.

    Both lists are built from counts per day, so they are as long as the dictionary and the source list.
    """
    per_source = daily_sources(tagged)
    by_day = per_source.groupBy("day").agg(
        F.sum("n").alias("article_count"),
        F.count(blank_to_null("source")).alias("source_count"),
        F.sum("matched").alias("matched_count"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("source"), "n")))
        ).alias("sources"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-col("n")).alias("key"), col("entity").alias("name"), col("n").alias("count"))))
    entities = daily_entities(tagged).groupBy("day").agg(
        F.transform(ordered, lambda e: F.struct(e["name"], e["count"])).alias("top_entities")
    )
    return by_day.join(entities, "day", "left").select(
        "day", F.lit(category).alias("category"), "article_count", "source_count", "matched_count", "top_entities", "sources"
    )


def lookback_window(articles: DataFrame, *, as_of: dt.datetime, minimum_days: int = 14) -> DataFrame:
    """Newest event time per category and the days to look back to include it."""
    latest = articles.groupBy("category").agg(F.max(event_time()).alias("latest"))
    age = F.date_diff(F.lit(as_of.date()), F.to_date("latest")) + 1
    days = F.greatest(F.lit(minimum_days), F.coalesce(age, F.lit(minimum_days)))
    return latest.withColumn("lookback_days", days.cast("bigint"))


def parse_entities(articles: DataFrame) -> DataFrame:
    """``entities_json`` text as the map column; unreadable text gives NULL."""
    return articles.withColumn("matched_entities", F.from_json("entities_json", ENTITY_MAP))


def first_per_source(articles: DataFrame, *order, limit: int) -> DataFrame:
    """First rows of every source; each task drops the rest before the shuffle."""
    from pyspark.sql import Window as W

    window = W.partitionBy("source").orderBy(*order)
    return articles.withColumn("rank", F.row_number().over(window)).where(col("rank") <= limit)


def select_sources(sources: DataFrame, excluded: DataFrame, *, max_sources: int | None = None) -> DataFrame:
    """Sources not excluded by name, the first ``max_sources`` of them, and of these the enabled ones."""
    kept = sources.join(excluded.select("name").distinct(), "name", "left_anti")
    if max_sources is not None:
        kept = kept.orderBy("position").limit(max_sources)
    browser = F.lower("type").isin("javascript", "browser")
    return kept.where("enabled").withColumn("needs_browser", browser)
