"""Registration, and the article-shaped views of the given tables in Spark and in SQL.

The given tables hold no links, identifiers or errors, so the views derive them from ``doc_id`` by rules that
are written alike on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import configure, spread
from ..sources.config import QualitySettings, keywords_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2024, 1, 4)
AS_OF_SQL = "TIMESTAMP '2024-01-04 00:00:00'"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def register(sql: str | None = None):
    """Register a query under its function name, with its SQL where there is one."""

    def add(function):
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def stamp(name: str):
    """A time as text, so that both engines print it alike."""
    return F.date_format(name, STAMP).alias(name.split(".")[-1])


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"


def articles_view(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles; the event with the number of the document gives the time."""
    documents = spread(table(spark, folder, "documents"))
    events = table(spark, folder, "events").select("event_id", col("ts").cast("timestamp").alias("ts"))
    rows = documents.join(events, documents["doc_id"] == events["event_id"], "left")
    return rows.select(
        "doc_id",
        "n_chars",
        F.concat_ws("/", F.concat(F.lit("https://"), "source", F.lit(".example.org")), "lang", "doc_id").alias("link"),
        F.trim(F.substring_index("text", ".", 1)).alias("title"),
        col("text").alias("summary"),
        F.when(col("doc_id") % 7 != 0, col("ts")).alias("published"),
        "source",
        col("lang").alias("category"),
        (col("ts") + F.expr("interval 1 day")).alias("collected_at"),
        F.array(
            F.concat(F.lit("Author "), (col("doc_id") % 13).cast("string")),
            F.concat(F.lit("Author "), (col("doc_id") % 17).cast("string")),
        ).alias("authors"),
    )


ARTICLES = """
articles_v AS (
  SELECT d.doc_id, d.n_chars,
         'https://' || d.source || '.example.org/' || d.lang || '/' || d.doc_id AS link,
         trim(split_part(d.text, '.', 1)) AS title,
         d.text AS summary,
         CASE WHEN d.doc_id % 7 <> 0 THEN e.ts END AS published,
         d.source, d.lang AS category,
         e.ts + INTERVAL 1 DAY AS collected_at,
         ['Author ' || (d.doc_id % 13), 'Author ' || (d.doc_id % 17)] AS authors
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id
)"""


def signals_view(spark: SparkSession, folder: str) -> DataFrame:
    """Articles whose summary ends with synthetic labelled fields, by the number of the document."""
    rows = articles_view(spark, folder)
    n = col("doc_id")

    def part(condition, *pieces):
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces]))

    padded = F.lpad(n.cast("string"), 5, "0")
    suffix = F.concat_ws(
        "",
        part(n % 3 == 0, " DOI: 10.1234/Doc.", n),
        part(n % 5 == 0, " arXiv: 2401.", padded, "v1 Announce"),
        part(n % 4 == 0, " Repository: github.com/org", n % 9, "/repo", n, "."),
        part(n % 8 == 1, " See https://github.com/free", n % 9, "/tool", n, ".git today."),
        part(n % 2 == 0, " Citation count: ", F.format_number(col("n_chars"), 0)),
        part(n % 10 == 0, " Benchmark: bench", n % 6, ". Metric name: acc. Metric value: ", n % 100),
    )
    link = F.when(n % 11 == 0, F.concat(F.lit("https://arxiv.org/abs/2402."), padded)).otherwise(col("link"))
    return rows.withColumns({"summary": F.concat("summary", suffix), "link": link})


SIGNALS = (
    ARTICLES
    + """,
signals_v AS (
  SELECT doc_id, n_chars,
         CASE WHEN doc_id % 11 = 0 THEN 'https://arxiv.org/abs/2402.' || lpad(doc_id::VARCHAR, 5, '0') ELSE link END AS link,
         title,
         summary
           || CASE WHEN doc_id % 3 = 0 THEN ' DOI: 10.1234/Doc.' || doc_id ELSE '' END
           || CASE WHEN doc_id % 5 = 0 THEN ' arXiv: 2401.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1 Announce' ELSE '' END
           || CASE WHEN doc_id % 4 = 0 THEN ' Repository: github.com/org' || (doc_id % 9) || '/repo' || doc_id || '.' ELSE '' END
           || CASE WHEN doc_id % 8 = 1 THEN ' See https://github.com/free' || (doc_id % 9) || '/tool' || doc_id || '.git today.' ELSE '' END
           || CASE WHEN doc_id % 2 = 0 THEN ' Citation count: ' || format('{:,}', n_chars) ELSE '' END
           || CASE WHEN doc_id % 10 = 0 THEN ' Benchmark: bench' || (doc_id % 6) || '. Metric name: acc. Metric value: ' || (doc_id % 100) ELSE '' END
           AS summary,
         published, source, category, collected_at, authors
  FROM articles_v
)"""
)


def dirty_view(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with faults: no title, no scheme, blank summary, empty source."""
    rows, n = articles_view(spark, folder), col("doc_id")
    return rows.withColumns(
        {
            "title": F.when(n % 11 != 0, col("title")),
            "link": F.when(n % 13 == 0, F.replace("link", F.lit("https://"), F.lit(""))).otherwise(col("link")),
            "summary": F.when(n % 17 == 0, F.lit("  ")).otherwise(col("summary")),
            "source": F.when(n % 19 == 0, F.lit("")).otherwise(col("source")),
        }
    )


DIRTY = (
    ARTICLES
    + """,
dirty_v AS (
  SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN title END AS title,
         CASE WHEN doc_id % 13 = 0 THEN replace(link, 'https://', '') ELSE link END AS link,
         CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE summary END AS summary,
         CASE WHEN doc_id % 19 = 0 THEN '' ELSE source END AS source,
         category, published, collected_at, authors
  FROM articles_v
)"""
)

#: The messages of each part of a row, where it has a fault.
MESSAGES = (
    DIRTY
    + r""",
parts AS (SELECT doc_id, source, link,
  CASE WHEN title IS NULL OR title = '' THEN 'title is missing or not a string' WHEN trim(regexp_replace(title, '\s', '', 'g')) = '' THEN 'title is empty' END AS m1,
  CASE WHEN link = '' THEN 'link is missing or not a string' WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'link has invalid URL format: ' || link END AS m2,
  CASE WHEN summary IS NULL OR summary = '' THEN 'summary is missing or not a string' WHEN trim(regexp_replace(summary, '\s', '', 'g')) = '' THEN 'summary is empty' END AS m3,
  CASE WHEN source IS NULL OR source = '' THEN 'source is missing or not a string' END AS m4 FROM dirty_v)"""
)


def copies_view(spark: SparkSession, folder: str) -> DataFrame:
    """Articles whose link leaves out the number, so that copies share title and link."""
    rows = articles_view(spark, folder)
    return rows.withColumn("link", F.regexp_replace("link", r"/\d+$", ""))


COPIES = (
    ARTICLES
    + """,
copies_v AS (SELECT * REPLACE (regexp_replace(link, '/[0-9]+$', '') AS link) FROM articles_v)"""
)

TRACKED = ["paper_release", "citation_snapshot", "code_repository", "benchmark_result", "weather_context"]

SETTINGS = QualitySettings(
    tracked_models=TRACKED,
    required_fields={
        "paper_release": ["paper_id", "title", "source_url", "doi", "published_date"],
        "citation_snapshot": ["paper_id", "citation_count", "source"],
        "code_repository": ["paper_id", "repository", "source_url", "license"],
        "benchmark_result": ["paper_id", "benchmark_name", "metric_name", "metric_value", "currency"],
    },
    freshness={"paper_release_days": 0.2, "citation_snapshot_hours": 6.0, "code_repository_day": 0.3},
    backlog=[
        {"name": "Citation service", "signal_type": "citation_snapshot", "activation_gate": "key mapping"},
        {"name": "Result board", "signal_type": "benchmark_result", "activation_gate": "terms"},
    ],
)


def sources_view(spark: SparkSession, folder: str) -> DataFrame:
    """Source dimension: the sources of the documents, described by their number."""
    names = table(spark, folder, "documents").select("source").distinct()
    n = F.substring("source", 4, 9).cast("int").alias("n")
    rows = names.select("source", n)
    n = col("n")

    def pick(modulus: int, *values: str):
        return F.get(F.array(*[F.lit(v) for v in values]), n % modulus)

    config = (
        F.when(n % 10 == 3, F.create_map(F.lit("event_model"), F.lit("benchmark_result")))
        .when(n % 10 == 4, F.create_map(F.lit("event_model"), F.lit("other_model")))
        .when(n % 10 == 5, F.create_map(F.lit("freshness_sla_days"), F.lit("2")))
        .when(
            n % 10 == 6,
            F.create_map(
                F.lit("repository"), F.lit("https://github.com/Conf/repo6.git"), F.lit("skip_reason"), F.lit("audit")
            ),
        )
        .otherwise(F.expr("cast(map() as map<string,string>)"))
    )
    purpose = (
        F.when(n % 7 == 0, F.array(F.lit("paper_release")))
        .when(n % 7 == 1, F.array(F.lit("news"), F.lit("code_repository")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select(
        n.alias("position"),
        col("source").alias("name"),
        pick(5, "rss", "arxiv", "api", "crossref", "javascript").alias("type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("url"),
        (n % 9 != 8).alias("enabled"),
        F.concat(F.lit("T"), (n % 3 + 1).cast("string")).alias("trust_tier"),
        F.concat(F.lit("C"), (n % 2).cast("string")).alias("collection_tier"),
        pick(6, "preprint", "benchmark_leaderboard", "implementation code", "editorial", "citation_signal", "news").alias(
            "content_type"
        ),
        F.concat(F.lit("role"), (n % 4).cast("string")).alias("producer_role"),
        purpose.alias("info_purpose"),
        config.alias("config"),
    )


SOURCES = """
source_numbers AS (
  SELECT DISTINCT source AS name, substr(source, 4)::INTEGER AS n FROM documents
),
sources_v AS (
  SELECT n AS position, name,
         CASE n % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'api' WHEN 3 THEN 'crossref' ELSE 'javascript' END AS type,
         'https://' || name || '.example.org' AS url,
         n % 9 <> 8 AS enabled,
         'T' || (n % 3 + 1) AS trust_tier,
         'C' || (n % 2) AS collection_tier,
         CASE n % 6 WHEN 0 THEN 'preprint' WHEN 1 THEN 'benchmark_leaderboard' WHEN 2 THEN 'implementation code'
                    WHEN 3 THEN 'editorial' WHEN 4 THEN 'citation_signal' ELSE 'news' END AS content_type,
         'role' || (n % 4) AS producer_role,
         CASE n % 7 WHEN 0 THEN 'paper_release' WHEN 1 THEN 'news code_repository' ELSE '' END AS purposes,
         CASE n % 7 WHEN 0 THEN 'paper_release' WHEN 1 THEN 'code_repository' END AS purpose_model,
         CASE n % 10 WHEN 3 THEN 'benchmark_result' WHEN 4 THEN 'other_model' END AS config_model,
         CASE n % 10 WHEN 5 THEN 2.0::DOUBLE END AS config_limit,
         CASE n % 10 WHEN 6 THEN 'github.com/Conf/repo6' ELSE '' END AS config_repository,
         CASE n % 10 WHEN 6 THEN 'audit' ELSE '' END AS skip_reason,
         CASE n % 10 WHEN 3 THEN 'benchmark_result' WHEN 4 THEN 'other_model' WHEN 5 THEN '2'
                     WHEN 6 THEN 'https://github.com/Conf/repo6.git audit' ELSE '' END AS config_text
  FROM source_numbers
),
source_text AS (
  SELECT *, lower(concat_ws(' ', name, type, content_type, collection_tier, producer_role, purposes, config_text)) AS txt
  FROM sources_v
),
source_models AS (
  SELECT *, coalesce(config_model, purpose_model,
    CASE WHEN contains(txt, 'benchmark') OR contains(txt, 'leaderboard') THEN 'benchmark_result'
         WHEN contains(txt, 'citation') THEN 'citation_snapshot'
         WHEN contains(txt, 'repository') OR contains(txt, 'github') OR contains(txt, 'code') THEN 'code_repository'
         WHEN contains(txt, 'preprint') OR contains(txt, 'academic') OR contains(txt, 'research') THEN 'paper_release'
         WHEN contains(txt, 'weather') THEN 'weather_context' END, '') AS event_model
  FROM source_text
),
dimension AS (
  SELECT *, event_model IN ('paper_release', 'citation_snapshot', 'code_repository', 'benchmark_result', 'weather_context') AS tracked,
         coalesce(config_limit, CASE event_model WHEN 'paper_release' THEN 0.2::DOUBLE WHEN 'citation_snapshot' THEN 6.0::DOUBLE / 24
                                                WHEN 'code_repository' THEN 0.3::DOUBLE END) AS freshness_sla_days
  FROM source_models
)"""

# Dictionary for the invented prose: accented, hyphenated, repeated and two-word keywords, and "ai", which the
# prose also has next to accented letters.
KEYWORDS = keywords_of(
    [
        {"name": "Licence", "keywords": ["License", "MIT License", "by-nc", "license", "GNU General Public License"]},
        {"name": "French", "keywords": ["que", "ré", "avec"]},
        {"name": "German", "keywords": ["für", "und", "sch"]},
        {"name": "Spanish", "keywords": ["ción", "para", "de los"]},
        {"name": "Common", "keywords": ["from", "the", "of the", "ai", "4.0"]},
    ]
)


def keywords_sql() -> str:
    """The dictionary as SQL rows: how a keyword is looked up, and the pattern of those of several words."""
    rows = []
    for k in KEYWORDS:
        kind = "part" if not k.keyword.isascii() else "word" if k.keyword.isalnum() else "pattern"
        literal = k.keyword.replace(".", "\\.")
        pattern = "(^|[^\\p{L}\\p{N}_])" + literal + "([^\\p{L}\\p{N}_]|$)"
        rows.append(f"('{k.entity}', {k.pos}, '{k.keyword}', '{kind}', '{pattern}')")
    return "keywords(entity, pos, keyword, kind, pattern) AS (VALUES " + ", ".join(rows) + ")"


TAGS = (
    ARTICLES
    + ", "
    + keywords_sql()
    + """,
texts AS MATERIALIZED (
  SELECT doc_id, link, lower(title || chr(10) || summary) AS t,
         regexp_extract_all(lower(title || chr(10) || summary), '[\\p{L}\\p{N}_]+') AS words
  FROM articles_v
),
hits AS (
  SELECT x.doc_id, x.link, k.entity, k.pos, k.keyword
  FROM texts x JOIN keywords k
    ON CASE WHEN k.kind = 'part' THEN contains(x.t, k.keyword)
            WHEN k.kind = 'word' THEN list_contains(x.words, k.keyword)
            ELSE contains(x.t, k.keyword) AND regexp_matches(x.t, k.pattern) END
),
tags AS (
  SELECT doc_id, link, entity, min(pos) AS first_pos, count(*) AS n,
         string_agg(keyword, '|' ORDER BY pos) AS listed,
         string_agg('"' || keyword || '"', ',' ORDER BY pos) AS quoted
  FROM hits GROUP BY ALL
)"""
)
