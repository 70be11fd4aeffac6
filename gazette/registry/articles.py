"""Queries on tagging, validation, duplicates, recency, summaries and graphs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import col, normalise_title, unescape_html
from ..functions.dates import coerce_date
from ..operators import duplicates, graph, recency, summary, tagging, validation
from ..sources.tables import partition_ages, write_json
from ..session import shared_folder, spread
from ..sources.feeds import entry_authors
from . import base
from .base import (
    ARTICLES, AS_OF, AS_OF_SQL, COPIES, DIRTY, KEYWORDS, MESSAGES, ORACLES, SIGNALS, SOURCES, TAGS, articles_view, copies_view,
    dirty_view, register, signals_view, sources_view, stamp, stamp_sql, table,
)


def tagged_view(spark, folder):
    return tagging.tag_articles(articles_view(spark, folder), KEYWORDS)


@register("SELECT source, count(*) AS n, false AS is_total FROM documents GROUP BY source "
          "UNION ALL SELECT NULL, count(*), true FROM documents")
def source_counts_total(spark, folder):
    return summary.source_totals(table(spark, folder, "documents"))


@register(f"WITH {ARTICLES} SELECT link, source, {stamp_sql('published')} AS published FROM articles_v "
          f"WHERE category = 'en' AND coalesce(published, collected_at) >= {AS_OF_SQL} - INTERVAL 2 DAY "
          "ORDER BY coalesce(published, collected_at) DESC, link LIMIT 200")
def recent_by_category(spark, folder):
    rows = recency.recent_by_category(articles_view(spark, folder), "en", as_of=AS_OF, days=2, limit=200)
    return rows.select("link", "source", stamp("published"))


@register(f"WITH {ARTICLES} SELECT title, source, link, {stamp_sql('collected_at')} AS collected_at FROM articles_v "
          f"WHERE collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY ORDER BY articles_v.collected_at DESC, link LIMIT 20")
def recent_updates(spark, folder):
    rows = recency.recent_updates(articles_view(spark, folder), as_of=AS_OF, days=1, limit=20)
    return rows.withColumn("collected_at", stamp("collected_at"))


@register(f"WITH {SIGNALS} SELECT title, source, link, CASE WHEN doc_id % 5 = 0 THEN '2401.' || doc_id END AS arxiv_id, "
          "CASE WHEN doc_id % 3 = 0 THEN '10.1234/' || doc_id END AS doi, NULL::VARCHAR AS venue, n_chars AS citation_count, "
          f"{stamp_sql('collected_at')} AS collected_at FROM signals_v "
          f"WHERE collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY ORDER BY signals_v.collected_at DESC, link LIMIT 20")
def recent_papers(spark, folder):
    papers = _papers(spark, folder).withColumn("venue", F.lit(None).cast("string"))
    rows = recency.recent_papers(papers.withColumn("citation_count", col("n_chars")), as_of=AS_OF, days=1, limit=20)
    return rows.withColumn("collected_at", stamp("collected_at"))


def _papers(spark, folder):
    n = col("doc_id")
    return signals_view(spark, folder).withColumns(
        {
            "doi": F.when(n % 3 == 0, F.concat(F.lit("10.1234/"), n.cast("string"))),
            "arxiv_id": F.when(n % 5 == 0, F.concat(F.lit("2401."), n.cast("string"))),
        }
    )


PAPERS = (
    SIGNALS + ", papers_v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '10.1234/' || doc_id END AS doi, "
    "CASE WHEN doc_id % 5 = 0 THEN '2401.' || doc_id END AS arxiv_id FROM signals_v)"
)


@register(f"""WITH {PAPERS},
ids AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN '10.1234/' || event_id WHEN 1 THEN '2401.' || event_id
               ELSE 'https://arxiv.org/abs/2402.' || lpad(event_id::VARCHAR, 5, '0') END AS identifier FROM events),
found AS (SELECT i.identifier, p.*, row_number() OVER (PARTITION BY i.identifier ORDER BY p.link) AS r
          FROM ids i JOIN papers_v p ON i.identifier = p.doi OR i.identifier = p.arxiv_id OR i.identifier = p.link)
SELECT identifier, link, title, CASE WHEN length(summary) > 300 THEN "left"(summary, 300) || '...' ELSE summary END AS summary
FROM found WHERE r = 1""")
def lookup_by_identifier(spark, folder):
    n = col("event_id")
    number = n.cast("string")
    identifier = (
        F.when(n % 3 == 0, F.concat(F.lit("10.1234/"), number))
        .when(n % 3 == 1, F.concat(F.lit("2401."), number))
        .otherwise(F.concat(F.lit("https://arxiv.org/abs/2402."), F.lpad(number, 5, "0")))
    )
    ids = table(spark, folder, "events").select(identifier.alias("identifier"))
    return recency.lookup(_papers(spark, folder), ids).select("identifier", "link", "title", "summary")


@register(f"WITH {ARTICLES} SELECT link, {stamp_sql('coalesce(published, collected_at)')} AS event_time FROM articles_v "
          f"WHERE coalesce(published, collected_at) >= {AS_OF_SQL} - INTERVAL 2 DAY")
def retention_keep(spark, folder):
    rows = recency.keep_recent(articles_view(spark, folder), as_of=AS_OF, keep_days=2)
    return rows.select("link", F.date_format(recency.event_time(), base.STAMP).alias("event_time"))


@register(f"WITH {ARTICLES} SELECT count(*) FILTER (coalesce(published, collected_at) < {AS_OF_SQL} - INTERVAL 2 DAY) AS removed, "
          f"count(*) FILTER (coalesce(published, collected_at) >= {AS_OF_SQL} - INTERVAL 2 DAY) AS kept FROM articles_v")
def retention_count(spark, folder):
    return recency.expired_count(articles_view(spark, folder), as_of=AS_OF, keep_days=2)


@register("""WITH days AS (SELECT DISTINCT ts::DATE AS d FROM events),
names AS (SELECT strftime(d, '%Y-%m-%d') AS name, d FROM days UNION ALL SELECT 'report_' || strftime(d, '%Y%m%d') || '.html', d FROM days
          UNION ALL SELECT 'notes-' || strftime(d, '%Y-%m-%d'), NULL FROM days)
SELECT name, strftime(d, '%Y-%m-%d') AS day, coalesce(d < DATE '2024-01-15', false) AS expired FROM names""")
def partition_retention(spark, folder):
    day = F.to_date("ts")
    days = table(spark, folder, "events").select(day.alias("d")).distinct()
    forms = F.array(
        F.date_format("d", "yyyy-MM-dd"),
        F.concat(F.lit("report_"), F.date_format("d", "yyyyMMdd"), F.lit(".html")),
        F.concat(F.lit("notes-"), F.date_format("d", "yyyy-MM-dd")),
    )
    names = days.select(F.explode(forms).alias("name"))
    rows = partition_ages(names, today=dt.date(2024, 1, 31), keep_days=16)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(f"""WITH {MESSAGES}
SELECT doc_id, concat_ws(', ', m1, m2, m3, m4) AS messages, concat_ws(', ', m1, m2, m3, m4) = '' AS valid FROM parts""")
def validate_split(spark, folder):
    rows = validation.with_messages(dirty_view(spark, folder))
    return rows.select("doc_id", F.array_join("messages", ", ").alias("messages"), (F.size("messages") == 0).alias("valid"))


@register(f"""WITH {DIRTY},
urls AS (SELECT 'pages' AS origin, url FROM pages UNION ALL SELECT source, link FROM dirty_v)
SELECT origin, count(*) FILTER (regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')) AS valid,
       count(*) FILTER (NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')) AS invalid FROM urls GROUP BY origin""")
def url_validity(spark, folder):
    urls = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), "url")
    urls = urls.unionByName(dirty_view(spark, folder).select(col("source").alias("origin"), col("link").alias("url")))
    return validation.url_validity(urls, "url", "origin")


_TITLE_SQL = (
    "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), "
    "'[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
)


@register("SELECT doc_id, " + _TITLE_SQL.format("text") + " AS title FROM documents")
def title_normalised(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return documents.select("doc_id", normalise_title("text").alias("title"))


@register(f"WITH {COPIES}, keyed AS (SELECT link, {_TITLE_SQL.format('title')} AS norm_title, "
          "regexp_extract(link, '^https://([^/]*)', 1) AS authority, regexp_extract(link, '^https://[^/]*(.*)$', 1) AS path FROM copies_v) "
          "SELECT norm_title, authority, path, count(*) AS copies, min(link) AS first_link FROM keyed GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark, folder):
    return duplicates.exact_duplicates(copies_view(spark, folder))


@register()
def fuzzy_duplicates(spark, folder):
    """All articles on one host, with a hundred documents per path."""
    rows = articles_view(spark, folder)
    place = F.concat_ws("/", F.lit("https://host.example.org"), "category", F.floor(col("doc_id") / 100).cast("string"))
    return duplicates.fuzzy_duplicates(rows.withColumn("link", place))


@register()
def similar_urls(spark, folder):
    return duplicates.similar_urls(table(spark, folder, "pages"), "url")


@register(f"WITH {COPIES} SELECT regexp_extract(link, '^https://([^/]*)', 1) AS authority, "
          "regexp_extract(link, '^https://[^/]*(.*)$', 1) AS path, count(*) AS urls, min(link) AS first_url "
          "FROM copies_v GROUP BY 1, 2 HAVING count(*) > 1")
def equal_urls(spark, folder):
    return duplicates.equal_urls(copies_view(spark, folder), "link")


@register(f"WITH {TAGS} SELECT doc_id, entity, listed AS keywords FROM tags")
def entity_tags(spark, folder):
    rows = tagging.entity_rows(tagged_view(spark, folder), "doc_id")
    return rows.select("doc_id", "entity", F.array_join("keywords", "|").alias("keywords"))


@register(f"WITH {TAGS} SELECT doc_id, entity, listed AS keywords FROM tags")
def entity_tags_joined(spark, folder):
    """The plan for large dictionaries."""
    rows = tagging.tag_articles(articles_view(spark, folder), KEYWORDS, key="doc_id", plan=tagging.JOINED)
    rows = tagging.entity_rows(rows, "doc_id")
    return rows.select("doc_id", "entity", F.array_join("keywords", "|").alias("keywords"))


@register(f"WITH {TAGS} SELECT entity, keyword, count(*) AS hits FROM hits GROUP BY ALL")
def keyword_totals(spark, folder):
    return tagging.keyword_totals(tagged_view(spark, folder))


@register(f"""WITH {TAGS},
j AS (SELECT doc_id, '{{' || string_agg('"' || entity || '":[' || quoted || ']', ',' ORDER BY first_pos) || '}}' AS entities_json FROM tags GROUP BY doc_id)
SELECT a.doc_id, coalesce(j.entities_json, '{{}}') AS entities_json FROM articles_v a LEFT JOIN j USING (doc_id)""")
def entity_json(spark, folder):
    return tagging.entity_json(tagged_view(spark, folder)).select("doc_id", "entities_json")


def _broken_json(rows):
    """Some rows with unreadable JSON and some with a value that is no list."""
    n = col("doc_id")
    return rows.withColumn(
        "entities_json",
        F.when(n % 23 == 0, F.lit("{broken"))
        .when(n % 29 == 0, F.lit('{"French": "text", "German": ["a", "b"], "Other": {"x": [1]}}'))
        .otherwise(col("entities_json")),
    )


@register(f"""WITH {TAGS}, counted AS (
  SELECT t.entity, t.n FROM tags t JOIN articles_v a USING (doc_id)
  WHERE a.collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY AND doc_id % 23 <> 0 AND doc_id % 29 <> 0
  UNION ALL SELECT 'German', 2 FROM articles_v a
  WHERE a.collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY AND doc_id % 23 <> 0 AND doc_id % 29 = 0)
SELECT entity, sum(n)::BIGINT AS n FROM counted GROUP BY entity ORDER BY n DESC, entity LIMIT 4""")
def top_trends(spark, folder):
    rows = _broken_json(tagging.entity_json(tagged_view(spark, folder)))
    return summary.top_trends(rows, as_of=AS_OF, days=1, limit=4)


@register(f"""WITH {TAGS}, entities AS (SELECT DISTINCT doc_id, entity FROM tags)
SELECT a.entity AS "left", b.entity AS "right", count(*) AS weight
FROM entities a JOIN entities b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2""")
def topic_edges(spark, folder):
    return graph.topic_edges(tagged_view(spark, folder))


@register(f"""WITH {ARTICLES}
SELECT least(authors[1], authors[2]) AS "left", greatest(authors[1], authors[2]) AS "right", count(*) AS weight
FROM articles_v GROUP BY 1, 2""")
def author_edges(spark, folder):
    return graph.author_edges(articles_view(spark, folder))


@register(f"""WITH {ARTICLES}, ends AS (SELECT unnest(list_distinct(authors)) AS node FROM articles_v)
SELECT node, count(*) AS weight FROM ends GROUP BY node""")
def node_weights(spark, folder):
    return graph.node_weights(graph.author_edges(articles_view(spark, folder)))


@register(f"""WITH {TAGS}, {SOURCES}, matched AS (SELECT DISTINCT doc_id FROM tags),
collected AS (SELECT d.*, m.doc_id IS NOT NULL AS is_matched FROM articles_v d LEFT JOIN matched m USING (doc_id)),
valid AS (SELECT * FROM collected WHERE title <> '' AND regexp_replace(title, '\\s', '', 'g') <> ''
          AND regexp_replace(summary, '\\s', '', 'g') <> '')
SELECT (SELECT count(*) FROM valid) AS article_count, (SELECT count(DISTINCT nullif(source, '')) FROM valid) AS source_count,
       (SELECT count(*) FILTER (is_matched) FROM valid) AS matched_count, 20 AS sources,
       count(*) AS collected, count(*) FILTER (is_matched) AS collected_matched, (SELECT count(*) FROM valid) AS validated,
       2 AS window_days FROM collected""")
def run_stats(spark, folder):
    rows = tagged_view(spark, folder)
    return summary.run_statistics(validation.valid_rows(rows), rows, configured_sources=20, window_days=2)


@register(f"""WITH {TAGS}, dated AS (SELECT doc_id, source, coalesce(published, collected_at)::DATE AS day FROM articles_v),
counts AS (SELECT day, source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM tags)) AS m FROM dated GROUP BY ALL),
per_day AS (SELECT day, sum(n)::BIGINT AS article_count, count(*) AS source_count, sum(m)::BIGINT AS matched_count,
                   array_to_string(list_sort(list(source || '=' || n)), ',') AS sources FROM counts GROUP BY day),
ents AS (SELECT day, entity, sum(n)::BIGINT AS n FROM tags JOIN dated USING (doc_id) GROUP BY ALL),
top AS (SELECT day, string_agg(entity || '=' || n, ',' ORDER BY n DESC, entity) AS top_entities FROM ents GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, 'research' AS category, article_count, source_count, matched_count, top_entities, sources
FROM per_day LEFT JOIN top USING (day)""")
def daily_summary(spark, folder):
    return _shown_summary(summary.daily_summary(tagged_view(spark, folder), category="research"))


def _shown_summary(rows):
    entities = F.transform("top_entities", lambda e: F.concat_ws("=", e["name"], e["count"].cast("string")))
    pairs = F.transform(F.map_entries("sources"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumns(
        {
            "day": F.date_format("day", "yyyy-MM-dd"),
            "top_entities": F.array_join(entities, ","),
            "sources": F.array_join(F.array_sort(pairs), ","),
        }
    )


@register(ORACLES["daily_summary"])
def summary_sink(spark, folder):
    """The summaries written as JSON and read back."""
    rows = summary.daily_summary(tagged_view(spark, folder), category="research")
    place = shared_folder(spark, "summaries")
    write_json(rows, place)
    return _shown_summary(spark.read.schema(rows.schema).json(place))


@register(f"""WITH {ARTICLES}, latest AS (SELECT category, max(coalesce(published, collected_at)) AS t FROM articles_v GROUP BY category)
SELECT category, {stamp_sql('t')} AS latest, greatest(14, date_diff('day', t::DATE, DATE '2024-01-31') + 1)::BIGINT AS lookback_days FROM latest""")
def lookback_window(spark, folder):
    rows = summary.lookback_window(articles_view(spark, folder), as_of=dt.datetime(2024, 1, 31))
    return rows.withColumn("latest", stamp("latest"))


@register(f"""WITH {ARTICLES}, ranked AS (SELECT link, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM articles_v)
SELECT link, source, rank FROM ranked WHERE rank <= 5""")
def first_n_per_source(spark, folder):
    rows = summary.first_per_source(articles_view(spark, folder), col("doc_id"), limit=5)
    return rows.select("link", "source", "rank")


@register(f"""WITH {ARTICLES} SELECT link, source, NULL::VARCHAR AS arxiv_id FROM articles_v WHERE category = 'en'
UNION ALL SELECT link, source, '2401.' || doc_id FROM articles_v WHERE category <> 'en'""")
def union_sources(spark, folder):
    rows = articles_view(spark, folder)
    left = rows.where("category = 'en'").select("link", "source")
    right = rows.where("category <> 'en'").select("link", "source", F.concat(F.lit("2401."), "doc_id").alias("arxiv_id"))
    return left.unionByName(right, allowMissingColumns=True)


@register(f"""WITH {SOURCES}, kept AS (SELECT * FROM sources_v WHERE name NOT IN ('src3', 'src7') ORDER BY position LIMIT 12)
SELECT name, position, type, type IN ('javascript', 'browser') AS needs_browser FROM kept WHERE enabled""")
def source_selection(spark, folder):
    sources = sources_view(spark, folder)
    excluded = sources.where(col("name").isin("src3", "src7")).select("name")
    return summary.select_sources(sources, excluded, max_sources=12).select("name", "position", "type", "needs_browser")


@register(f"""WITH {DIRTY} SELECT doc_id, title, link, coalesce(nullif(summary, ''), title) AS summary FROM (
  SELECT doc_id, trim(coalesce(title, '')) AS title, trim(link) AS link, CASE WHEN doc_id % 5 = 0 THEN '' ELSE summary END AS summary FROM dirty_v)
WHERE title <> '' AND title <> '(no title)' AND link <> ''""")
def incomplete_rows(spark, folder):
    rows = dirty_view(spark, folder)
    rows = rows.withColumn("summary", F.when(col("doc_id") % 5 == 0, F.lit("")).otherwise(col("summary")))
    return validation.complete_rows(rows).select("doc_id", "title", "link", "summary")


@register(f"""WITH {ARTICLES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Author ' || (doc_id % 13) || '|' || 'Author ' || (doc_id % 17)
  WHEN doc_id % 3 = 1 THEN source ELSE '' END AS authors FROM articles_v""")
def authors_fallback(spark, folder):
    n = col("doc_id")
    given = F.when(n % 3 == 0, F.transform("authors", lambda a: F.concat(F.lit(" "), a, F.lit(" ")))).when(
        n % 3 == 1, F.array(F.lit(" "), F.lit(""))
    )
    single = F.when(n % 3 < 2, col("source")).otherwise(F.lit(" "))
    rows = articles_view(spark, folder).select("doc_id", entry_authors(given, single).alias("a"))
    return rows.select("doc_id", F.array_join("a", "|").alias("authors"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def dates_coerced(spark, folder):
    n, when = col("o_orderkey"), col("o_orderdate").cast("timestamp")
    text = (
        F.when(n % 5 == 0, F.date_format(when, "yyyy-MM-dd"))
        .when(n % 5 == 1, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n % 5 == 2, F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
        .when(n % 5 == 3, F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit(" at noon")))
        .otherwise(F.date_format(when, "dd.MM.yyyy"))
    )
    rows = table(spark, folder, "orders").select("o_orderkey", coerce_date(text).alias("day"))
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("""SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM pages""")
def html_unescape_subset(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", unescape_html("html").alias("text"))
