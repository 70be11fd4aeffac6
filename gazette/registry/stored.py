"""Queries that write tables, logs, snapshots and streams to the shared folder and read them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.tagging import tag_articles
from ..plans.ingest_run import ingest_run
from ..session import shared_folder
from ..sources import raw_log, tables
from ..sources.config import Category
from ..sources.parted_table import PartedTable
from ..streaming.jobs import counts_by_batch, daily_counts_stream, ingest_stream, raw_stream, read_counts
from .base import (
    ARTICLES, AS_OF, AS_OF_SQL, KEYWORDS, SETTINGS, TAGS, articles_view, register, stamp, stamp_sql, table,
)
from .feeds import rss_payloads

RUN_TIME = dt.datetime(2024, 1, 5, 6, 0)


@register(f"""WITH current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1),
batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'error') WHERE r = 1)
SELECT user_id, event_id, event_type, value FROM batch
UNION ALL SELECT user_id, event_id, event_type, value FROM current WHERE user_id NOT IN (SELECT user_id FROM batch)""")
def upsert_latest(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts")
    order = [col("ts").desc(), col("event_id")]
    current = tables.newest_per_key(events.where("event_type <> 'error'"), "user_id", *order)
    batch = events.where("event_type = 'error'")
    return tables.merge_by_key(current, batch, key="user_id", order=order).drop("ts")


@register(f"""WITH {ARTICLES}, kept AS (SELECT * FROM articles_v WHERE coalesce(published, collected_at) >= {AS_OF_SQL} - INTERVAL 2 DAY)
SELECT (SELECT count(*) FROM articles_v) - (SELECT count(*) FROM kept) AS removed, count(*) AS kept, count(DISTINCT link) AS links FROM kept""")
def retention_rewrite(spark, folder):
    """Store, upsert once more, drop the days that are too old, and read what is left."""
    stored = PartedTable(spark, shared_folder(spark, "table"), buckets=4)
    rows = articles_view(spark, folder).drop("summary")
    stored.upsert(rows, order=[col("doc_id")])
    stored.upsert(rows.where("doc_id % 2 = 0"), order=[col("doc_id")])
    removed = stored.delete_older_than(as_of=AS_OF, keep_days=2)
    return stored.read().agg(
        F.lit(removed).cast("bigint").alias("removed"),
        F.count(F.lit(1)).alias("kept"),
        F.countDistinct("link").alias("links"),
    )


@register(f"""WITH {ARTICLES}, first_v AS (SELECT * FROM articles_v WHERE doc_id % 3 > 0),
second_v AS (SELECT link, 'Second ' || title AS title, coalesce(published, collected_at) + INTERVAL (doc_id % 4) HOUR AS published, source FROM articles_v WHERE doc_id % 3 = 0 OR doc_id % 10 = 1),
both_v AS (SELECT * FROM second_v UNION ALL SELECT link, title, published, source FROM first_v WHERE link NOT IN (SELECT link FROM second_v))
SELECT link, title, source, {stamp_sql('published')} AS published FROM both_v""")
def upsert_parts(spark, folder):
    """A second batch adds rows, replaces some and moves them to other days."""
    stored = PartedTable(spark, shared_folder(spark, "table"), buckets=4)
    rows = articles_view(spark, folder)
    time = F.coalesce("published", "collected_at") + F.make_dt_interval(hours=col("doc_id") % 4)
    stored.upsert(rows.where("doc_id % 3 > 0"), order=[col("doc_id")])
    second = rows.where("doc_id % 3 = 0 or doc_id % 10 = 1")
    stored.upsert(second.withColumns({"title": F.concat(F.lit("Second "), "title"), "published": time}), order=[col("doc_id")])
    return stored.read().select("link", "title", "source", stamp("published"))


@register(f"WITH {ARTICLES} SELECT source, link, title, summary FROM articles_v")
def raw_roundtrip(spark, folder):
    place = shared_folder(spark, "raw")
    raw_log.log_articles(articles_view(spark, folder), place, logged_at=RUN_TIME)
    return raw_log.read_raw(spark, place).select("source", "link", "title", "summary")


@register(f"WITH {ARTICLES} SELECT source, count(*) AS n, count(DISTINCT link) AS links FROM articles_v GROUP BY source")
def raw_rerun_dedupe(spark, folder):
    """The second run with the same id logs only what the first one did not."""
    place = shared_folder(spark, "raw")
    rows = articles_view(spark, folder)
    raw_log.log_articles(rows.where("doc_id % 3 > 0"), place, logged_at=RUN_TIME, run_id="run1")
    raw_log.log_articles(rows, place, logged_at=RUN_TIME, run_id="run1")
    logged = raw_log.read_raw(spark, place)
    return logged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link").alias("links"))


@register(f"""WITH {ARTICLES}, d AS (SELECT max(collected_at)::DATE AS day FROM articles_v)
SELECT link, title FROM articles_v, d WHERE collected_at::DATE = d.day""")
def latest_snapshot(spark, folder):
    """One snapshot for each day of collection; the newest is read."""
    place = shared_folder(spark, "daily")
    rows = articles_view(spark, folder).select("link", "title", F.to_date("collected_at").alias("day"))
    tables.write_snapshots(rows, place, "day")
    return tables.latest_snapshot(spark, place)


@register(f"WITH {ARTICLES} SELECT link, source FROM articles_v")
def snapshot_fallback(spark, folder):
    """The stored table is empty, so the latest snapshot with rows is read."""
    place = shared_folder(spark, "table")
    rows = articles_view(spark, folder).select("link", "source")
    tables.replace_table(rows.where("false"), place)
    tables.write_snapshot(rows, f"{place}-daily", AS_OF.date())
    return tables.read_with_fallback(spark, place, f"{place}-daily", f"{place}-none")


@register(f"WITH {ARTICLES} SELECT link, source FROM articles_v")
def table_choice(spark, folder):
    """There are no papers, so the articles are read."""
    rows = articles_view(spark, folder).select("link", "source")
    return tables.choose_table(rows.where("source = 'none'"), rows)


@register(f"WITH {ARTICLES} SELECT link, title, summary, '[\"' || array_to_string(authors, '\",\"') || '\"]' AS authors FROM articles_v")
def csv_roundtrip(spark, folder):
    place = shared_folder(spark, "csv")
    tables.write_csv(articles_view(spark, folder).select("link", "title", "summary", "authors"), place)
    rows = tables.read_csv(spark, place, "link string, title string, summary string, authors string")
    return rows.fillna("")


def _category():
    sources = [
        {"name": f"feed{i}", "type": "rss", "url": f"https://feed{i}.example.org", "info_purpose": ["paper_release"]}
        for i in range(20)
    ]
    return Category("research", "Research", sources, KEYWORDS, SETTINGS)


_FED = TAGS.replace("lower(title || chr(10) || summary)", "lower(title || ' © é' || chr(10) || CASE WHEN doc_id % 5 = 1 THEN title || ' © é' ELSE summary END)")


@register(f"""WITH {_FED} SELECT count(*) AS article_count, count(DISTINCT doc_id // 20 % 20) AS source_count, (SELECT count(DISTINCT doc_id) FROM tags) AS matched_count,
  20 AS sources, count(*) AS collected, (SELECT count(DISTINCT doc_id) FROM tags) AS collected_matched, count(*) AS validated, 7 AS window_days FROM articles_v""")
def ingest_whole_run(spark, folder):
    """A whole run over feeds made from all documents; its statistics."""
    payloads = rss_payloads(spark, folder)
    number = F.pmod(F.substring("source", 5, 9).cast("int"), F.lit(20))
    payloads = payloads.withColumn("source", F.concat(F.lit("feed"), number.cast("string")))
    result = ingest_run(
        spark, payloads, _category(), shared_folder(spark, "run"), as_of=AS_OF, snapshot=True, run_id="run1"
    )
    return result["statistics"]


@register(f"""WITH {ARTICLES} SELECT link, CASE WHEN doc_id % 2 = 0 THEN 'Newer ' || title ELSE title END AS title, source FROM articles_v
WHERE doc_id % 2 = 0 OR (title <> '' AND regexp_replace(title, '\\s', '', 'g') <> '')""")
def stream_ingest(spark, folder):
    """The log holds newer versions of half the rows; they win although their files come first."""
    place = shared_folder(spark, "landing")
    rows = articles_view(spark, folder)
    newer = rows.where("doc_id % 2 = 0").withColumn("title", F.concat(F.lit("Newer "), "title"))
    raw_log.append_plain(newer, f"{place}/a", logged_at=RUN_TIME + dt.timedelta(hours=1))
    raw_log.append_plain(rows, f"{place}/b", logged_at=RUN_TIME)
    query = ingest_stream(spark, place, f"{place}-table", f"{place}-state", files_per_batch=1)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return PartedTable(spark, f"{place}-table").read().select("link", "title", "source")


@register("""WITH last AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS source, count(*) AS n FROM events, last
WHERE ts::DATE + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def stream_daily_counts(spark, folder):
    """Days that the watermark has passed at the end of the stream."""
    place = shared_folder(spark, "landing")
    events = table(spark, folder, "events")
    rows = events.select(
        F.concat(F.lit("https://example.org/"), "event_id").alias("link"),
        col("event_type").alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("logged_at"),
    )
    rows.write.json(place)
    query = daily_counts_stream(raw_stream(spark, place), f"{place}-counts", f"{place}-state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    counts = spark.read.schema("day date, source string, n bigint, links bigint").parquet(f"{place}-counts")
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n")


@register("""SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS source, count(*) AS n, true AS links_close FROM events GROUP BY ALL""")
def stream_counts_all(spark, folder):
    """All days, though the newest rows are read first and all others come behind them."""
    place = shared_folder(spark, "landing")
    events = table(spark, folder, "events")
    rows = events.select(
        F.concat(F.lit("https://example.org/"), "event_id").alias("link"),
        col("event_type").alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("logged_at"),
    )
    newest = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).scalar()
    rows.where(col("logged_at") >= newest).coalesce(1).write.json(f"{place}/a")
    rows.where(col("logged_at") < newest).coalesce(2).write.json(f"{place}/b")
    query = counts_by_batch(raw_stream(spark, place, files_per_batch=1), f"{place}-counts", f"{place}-state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    counts = read_counts(spark, f"{place}-counts")
    # Every link stands once, so the rows are the links; the sketch is within a few percent.
    close = F.abs(col("links") - col("n")) <= F.greatest(F.lit(1), col("n") * 0.1)
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n", close.alias("links_close"))
