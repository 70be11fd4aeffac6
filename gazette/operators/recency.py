"""Recent rows, look-ups by identifier and retention by age."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, collapse_spaces


def event_time() -> Column:
    return F.coalesce(col("published"), col("collected_at"))


def _cutoff(as_of: dt.datetime, days: int) -> Column:
    return F.lit(as_of - dt.timedelta(days=days))


def recent_by_category(
    articles: DataFrame, category: str, *, as_of: dt.datetime, days: int = 7, limit: int | None = 200
) -> DataFrame:
    """Newest rows of a category by event time (publication, else collection); without a limit all, in no order."""
    kept = articles.where((col("category") == category) & (event_time() >= _cutoff(as_of, days)))
    return kept if limit is None else kept.orderBy(event_time().desc(), col("link")).limit(limit)


def recent_papers(papers: DataFrame, *, as_of: dt.datetime, days: int = 7, limit: int = 20) -> DataFrame:
    """Newest rows by collection time with the columns that describe a paper."""
    kept = papers.where(col("collected_at") >= _cutoff(as_of, days))
    names = ["title", "source", "link", "arxiv_id", "doi", "venue", "citation_count", "collected_at"]
    return kept.orderBy(col("collected_at").desc(), col("link")).limit(max(limit, 0)).select(*names)


def recent_updates(articles: DataFrame, *, as_of: dt.datetime, days: int = 7, limit: int = 20) -> DataFrame:
    kept = articles.where(col("collected_at") >= _cutoff(as_of, days))
    ordered = kept.orderBy(col("collected_at").desc(), col("link")).limit(max(limit, 0))
    return ordered.select("title", "source", "link", "collected_at")


def recent_hits(hits: DataFrame, articles: DataFrame, *, as_of: dt.datetime, days: int, key: str = "link") -> DataFrame:
    """Search hits whose article was collected in the window."""
    recent = articles.where(col("collected_at") >= _cutoff(as_of, days)).select(key)
    return hits.join(recent, key, "left_semi")


def lookup(papers: DataFrame, identifiers: DataFrame, *, id_column: str = "identifier") -> DataFrame:
    """One row per identifier that is a DOI, an arXiv id or a link of some paper (smallest link first).

    The keys of a paper are exploded (three at most) and joined by equality with its link alone; the chosen links then
    fetch their papers, with the summary already cut. ``papers`` holds a link once.
    """
    wanted = identifiers.select(collapse_spaces(id_column).alias(id_column)).where(col(id_column) != "").distinct()
    keys = F.array_distinct(F.filter(F.array("doi", "arxiv_id", "link"), lambda k: k.isNotNull()))
    keyed = papers.select("link", F.explode(keys).alias(id_column))
    first = keyed.join(wanted, id_column).groupBy(id_column).agg(F.min("link").alias("link"))
    abstract = F.when(
        F.length("summary") > 300, F.concat(F.left(col("summary"), F.lit(300)), F.lit("..."))
    ).otherwise(col("summary"))
    return papers.withColumn("summary", abstract).join(first, "link")


def keep_recent(articles: DataFrame, *, as_of: dt.datetime, keep_days: int) -> DataFrame:
    """The rows that retention keeps; stored tables drop the others by :meth:`gazette.sources.parted_table.PartedTable.delete_older_than`."""
    return articles.where(event_time() >= _cutoff(as_of, keep_days))


def expired_count(articles: DataFrame, *, as_of: dt.datetime, keep_days: int) -> DataFrame:
    old = event_time() < _cutoff(as_of, keep_days)
    return articles.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))
