"""Row validation and clean-up of incomplete rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_SPACE, blank_to_null, col, text_or_empty
from ..functions.urls import is_valid_url


def _is_blank(c: Column) -> Column:
    """No character but white space; the search ends at the first other one, so a long text is not read through."""
    return ~F.regexp_like(c, F.lit(NO_SPACE))


def validation_messages() -> Column:
    """Messages in the order title, link, summary, source, category; empty for a valid row."""
    title, link, summary = col("title"), col("link"), text_or_empty("summary")

    def missing(c: Column) -> Column:
        return c.isNull() | (c == "")

    def absent(name: str) -> Column:
        return F.lit(f"{name} is missing or not a string")

    checks = [
        F.when(missing(title), absent("title")).when(_is_blank(title), F.lit("title is empty")),
        F.when(missing(link), absent("link")).when(
            ~is_valid_url(link), F.concat(F.lit("link has invalid URL format: "), link)
        ),
        F.when(summary == "", absent("summary")).when(_is_blank(summary), F.lit("summary is empty")),
        F.when(missing(col("source")), absent("source")),
        F.when(missing(col("category")), absent("category")),
    ]
    return F.filter(F.array(*checks), lambda m: m.isNotNull())


def with_messages(articles: DataFrame) -> DataFrame:
    return articles.withColumn("messages", validation_messages())


def valid_rows(articles: DataFrame) -> DataFrame:
    return with_messages(articles).where(F.size("messages") == 0).drop("messages")


def error_rows(articles: DataFrame) -> DataFrame:
    """``source, link, message`` of the invalid rows; the message starts with the link."""
    bad = with_messages(articles).where(F.size("messages") > 0)
    text = F.concat(text_or_empty("link"), F.lit(": "), F.array_join("messages", ", "))
    return bad.select("source", "link", text.alias("message"))


def complete_rows(entries: DataFrame) -> DataFrame:
    """Feed rows with a title and a link; a missing summary becomes the title."""
    title, link = F.trim(text_or_empty("title")), F.trim(text_or_empty("link"))
    kept = entries.withColumn("title", title).withColumn("link", link)
    kept = kept.where((col("title") != "") & (col("title") != "(no title)") & (col("link") != ""))
    return kept.withColumn("summary", F.coalesce(blank_to_null("summary"), col("title")))


def url_validity(table: DataFrame, url: str, *group: str) -> DataFrame:
    """Valid and invalid URLs per group."""
    ok = is_valid_url(url)
    return table.groupBy(*group).agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")
    )
