"""Data-quality checks on any table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _unpivot(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide row as one row per struct."""
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing_fields(table: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """Rows per field that meet the caller's condition, with the share in percent; one scan."""
    names = list(conditions)
    counts = [F.count_if(F.expr(conditions[n])).alias(f"m{i}") for i, n in enumerate(names)]
    row = table.agg(F.count(F.lit(1)).alias("total"), *counts).where("total > 0")
    out = [
        F.struct(
            F.lit(n).alias("field"),
            col(f"m{i}").alias("missing"),
            col("total"),
            (col(f"m{i}") / col("total") * 100).alias("percent"),
        )
        for i, n in enumerate(names)
    ]
    return _unpivot(row, out)


def _repeated(table: DataFrame, column: str) -> DataFrame:
    return (
        table.groupBy(_name(column).alias("url")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def duplicate_urls(table: DataFrame, *, url_column: str = "url", limit: int = 10) -> DataFrame:
    return _repeated(table, url_column).orderBy(col("n").desc(), col("url")).limit(limit)


def duplicate_link_count(table: DataFrame, *, url_column: str = "link") -> DataFrame:
    return _repeated(table, url_column).agg(F.count(F.lit(1)).alias("duplicate_links"))


def _length_aggs(columns: Sequence[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(columns):
        n = F.length(_name(c))
        aggs += [F.avg(n).alias(f"a{i}"), F.min(n).alias(f"l{i}"), F.max(n).alias(f"h{i}")]
    return aggs


def text_lengths(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average, least and greatest length of every column; one scan."""
    row = table.agg(*_length_aggs(columns))
    out = [
        F.struct(
            F.lit(c).alias("column"),
            col(f"a{i}").alias("avg_length"),
            col(f"l{i}").cast("bigint").alias("min_length"),
            col(f"h{i}").cast("bigint").alias("max_length"),
        )
        for i, c in enumerate(columns)
    ]
    return _unpivot(row, out)


def language_values(
    table: DataFrame, *, language_column: str = "language", allowed: Collection[str] | None = None
) -> DataFrame:
    """Rows per language; a value outside ``allowed`` is invalid, NULL never is."""
    counts = table.groupBy(_name(language_column).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.lit(False)
    if allowed is not None:
        bad = col("language").isNotNull() & ~F.coalesce(col("language").isin(sorted(allowed)), F.lit(False))
    return counts.withColumn("invalid", bad)


def date_check(table: DataFrame, *, date_column: str, as_of: dt.datetime) -> DataFrame:
    c = _name(date_column).cast("timestamp")
    return table.agg(
        F.count_if(c > F.lit(as_of)).alias("future"), F.min(c).alias("oldest"), F.max(c).alias("newest")
    )


def date_check_fallback(articles: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """Oldest and newest event time, and rows published after ``as_of``."""
    when = F.coalesce(col("published"), col("collected_at"))
    return articles.agg(
        F.min(when).alias("oldest"),
        F.max(when).alias("newest"),
        F.count_if(col("published") > F.lit(as_of)).alias("future"),
    )


def all_checks(
    table: DataFrame,
    *,
    conditions: Mapping[str, str],
    text_columns: Sequence[str] = (),
    language_column: str = "language",
    allowed_languages: Collection[str] | None = None,
    url_column: str = "url",
    date_column: str = "published_at",
    as_of: dt.datetime,
    limit: int = 10,
) -> DataFrame:
    """All checks in long form ``check, item, metric, value`` (value as text).

    Row counts, lengths and dates come from one scan; the URL and the language groups need one each.
    """
    when = _name(date_column).cast("timestamp")
    row = table.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.expr(c)).alias(f"m{i}") for i, c in enumerate(conditions.values())],
        *_length_aggs(text_columns),
        F.count_if(when > F.lit(as_of)).alias("future"),
        F.min(when).alias("oldest"),
        F.max(when).alias("newest"),
    )

    def item(check: str, name: str, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(name).alias("item"),
            F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
        )

    stamp = "yyyy-MM-dd HH:mm:ss"
    out = [item("total", "", "rows", col("total"))]
    out += [item("missing", n, "rows", col(f"m{i}")) for i, n in enumerate(conditions)]
    for i, c in enumerate(text_columns):
        out += [
            item("length", c, "avg", F.format_string("%.4f", col(f"a{i}"))),
            item("length", c, "min", col(f"l{i}")),
            item("length", c, "max", col(f"h{i}")),
        ]
    out += [
        item("date", date_column, "future", col("future")),
        item("date", date_column, "oldest", F.date_format("oldest", stamp)),
        item("date", date_column, "newest", F.date_format("newest", stamp)),
    ]
    urls = duplicate_urls(table, url_column=url_column, limit=limit).select(
        F.lit("duplicate_url").alias("check"),
        col("url").alias("item"),
        F.lit("rows").alias("metric"),
        col("n").cast("string").alias("value"),
    )
    languages = language_values(table, language_column=language_column, allowed=allowed_languages).select(
        F.lit("language").alias("check"),
        col("language").alias("item"),
        F.when(col("invalid"), F.lit("invalid")).otherwise(F.lit("rows")).alias("metric"),
        col("n").cast("string").alias("value"),
    )
    return _unpivot(row, out).unionByName(urls).unionByName(languages)
