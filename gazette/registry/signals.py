"""Queries on labelled fields, identifiers, events and the health of the sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.dates import age_in_days
from ..functions.labelled import LABELS, field, labelled_fields
from ..functions.text import col
from ..operators import signals as ops
from ..operators import source_health as health
from ..operators.validation import error_rows
from ..sources.config import backlog_table
from ..plans.quality_report import quality_window, stored_quality_run, write_report
from ..session import shared_folder
from .base import (
    AS_OF, AS_OF_SQL, MESSAGES, ORACLES, SETTINGS, SIGNALS, SOURCES, TRACKED, articles_view, dirty_view, register, signals_view,
    sources_view, stamp, stamp_sql, table,
)


def _value(label: str) -> str:
    return (
        f"trim(split_part(list_filter(pieces, lambda x: lower(split_part(x, chr(57345), 1)) = '{label}')[1], chr(57345), 2), ' .;,')"
    )


def _slug(x: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), "
        f"'u-' || \"left\"(sha1({x}), 12))"
    )


_ALTERNATIVES = "|".join(sorted(LABELS, key=len, reverse=True))

FIELDS = (
    SIGNALS
    + f""",
pieces_v AS MATERIALIZED (
  SELECT *, (string_split(regexp_replace(trim(regexp_replace(title || ' ' || summary, '\\s+', ' ', 'g')),
      '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_ALTERNATIVES})\\s*[:=]\\s*', '\\1' || chr(57344) || '\\2' || chr(57345), 'g'), chr(57344)))[2:] AS pieces
  FROM signals_v
),
fields_v AS MATERIALIZED (
  SELECT *, {_value('arxiv')} AS f_arxiv, {_value('doi')} AS f_doi, {_value('repository')} AS f_repository,
         {_value('citation count')} AS f_citations, {_value('benchmark')} AS f_benchmark,
         coalesce({_value('metric')}, {_value('metric name')}, {_value('score')}, '') AS metric_name,
         nullif(coalesce({_value('metric value')}, {_value('score')}), '') AS metric_value
  FROM pieces_v
),
ids_v AS (
  SELECT *,
         CASE WHEN coalesce(f_arxiv, '') <> '' THEN regexp_extract(f_arxiv, '([0-9]{{4}}\\.[0-9]{{4,5}}(?:v\\d+)?)', 1)
              ELSE regexp_extract(link, '(?i)arxiv\\.org/(?:abs|pdf)/([0-9]{{4}}\\.[0-9]{{4,5}}(?:v\\d+)?)', 1) END AS arxiv_id,
         lower(coalesce(f_doi, '')) AS doi,
         regexp_extract(title || ' ' || summary || ' ' || link, '(?i)github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 1) AS free_owner,
         regexp_replace(regexp_extract(title || ' ' || summary || ' ' || link, '(?i)github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 2), '\\.git$', '') AS free_name,
         try_cast(replace(regexp_extract(coalesce(f_citations, ''), '(\\d[\\d,]*)', 1), ',', '') AS BIGINT) AS citation_count,
         CASE WHEN coalesce(f_benchmark, '') <> '' THEN f_benchmark WHEN contains(lower(title), 'benchmark') THEN title ELSE '' END AS benchmark_name,
         "left"({_slug('title')}, 96) AS normalized_title
  FROM fields_v
)"""
)

EVENTS = (
    FIELDS
    + ", "
    + SOURCES
    + f""",
joined AS (
  SELECT i.*, s.type AS source_type, s.trust_tier, s.event_model, s.url AS home,
         CASE WHEN s.config_repository <> '' THEN s.config_repository WHEN coalesce(f_repository, '') <> '' THEN f_repository
              WHEN free_owner <> '' THEN 'github.com/' || free_owner || '/' || free_name ELSE '' END AS repository,
         CASE WHEN s.event_model = 'citation_snapshot' AND collected_at IS NOT NULL THEN collected_at
              ELSE coalesce(published, collected_at) END AS event_at
  FROM ids_v i JOIN dimension s ON s.name = i.source WHERE s.tracked
),
keyed AS (
  SELECT *, CASE WHEN doi <> '' THEN 'doi:' || {_slug('doi')} WHEN arxiv_id <> '' THEN 'arxiv:' || {_slug('arxiv_id')}
                 ELSE 'title:' || normalized_title END AS paper_key,
         coalesce(nullif(doi, ''), nullif(arxiv_id, ''), nullif(link, ''), normalized_title) AS paper_id,
         split_part(repository, '/', 1) AS host, split_part(repository, '/', 2) AS owner, split_part(repository, '/', 3) AS name,
         lower(title || ' ' || summary || ' ' || link) AS txt
  FROM joined
),
events_v AS MATERIALIZED (
  SELECT *,
    CASE WHEN event_model = 'code_repository' AND repository <> '' THEN 'repository:' || {_slug('host')} || ':' || {_slug('owner')} || ':' || {_slug('name')} || ':paper:' || {_slug('paper_key')}
         WHEN event_model = 'benchmark_result' AND benchmark_name <> '' AND metric_name <> '' AND metric_value IS NOT NULL
         THEN 'benchmark:' || {_slug('paper_key')} || ':' || {_slug('benchmark_name')} || ':' || {_slug('metric_name')} || ':' || {_slug('metric_value')}
         ELSE 'paper:' || paper_key END AS canonical_key,
    CASE WHEN event_model = 'code_repository' AND repository <> '' THEN 'complete'
         WHEN event_model = 'benchmark_result' AND benchmark_name <> '' AND metric_name <> '' AND metric_value IS NOT NULL THEN 'complete'
         WHEN event_model IN ('paper_release', 'citation_snapshot') AND (doi <> '' OR arxiv_id <> '') THEN 'complete'
         WHEN event_model IN ('paper_release', 'citation_snapshot', 'code_repository', 'benchmark_result') THEN 'title_proxy'
         ELSE 'complete' END AS canonical_key_status,
    event_model || ':' || {_slug('source')} || ':' || "left"(sha1(paper_id), 12) || ':' || coalesce(strftime(event_at, '%Y-%m-%d'), 'undated') AS event_key,
    CASE event_model
      WHEN 'paper_release' THEN concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN doi = '' THEN 'doi' END, CASE WHEN event_at IS NULL THEN 'published_date' END)
      WHEN 'citation_snapshot' THEN concat_ws(',', CASE WHEN citation_count IS NULL THEN 'citation_count' END)
      WHEN 'code_repository' THEN concat_ws(',', CASE WHEN repository = '' THEN 'repository' END, CASE WHEN NOT contains(txt, 'license') THEN 'license' END)
      WHEN 'benchmark_result' THEN concat_ws(',', CASE WHEN benchmark_name = '' THEN 'benchmark_name' END, CASE WHEN metric_name = '' THEN 'metric_name' END,
           CASE WHEN metric_value IS NULL THEN 'metric_value' END,
           CASE WHEN NOT (contains(txt, 'usd') OR contains(txt, 'krw') OR contains(txt, '$') OR contains(txt, '원')) THEN 'currency' END)
      ELSE '' END AS gaps
  FROM keyed
)"""
)

HEALTH = (
    EVENTS
    + f""",
article_counts AS (SELECT source, count(*) AS article_count FROM signals_v GROUP BY source),
event_counts AS (SELECT source, count(*) AS event_count FROM events_v GROUP BY source),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_at DESC NULLS LAST, link, event_key) AS r FROM events_v) WHERE r = 1),
aged AS (
  SELECT d.position, d.name AS source, d.enabled, d.tracked, d.event_model, d.freshness_sla_days, d.skip_reason,
         coalesce(a.article_count, 0) AS article_count, coalesce(e.event_count, 0) AS event_count, l.event_at AS latest_event_at,
         CASE WHEN l.event_at IS NOT NULL THEN greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(l.event_at))::DOUBLE / 86400000000.0) END AS age,
         coalesce(l.title, '') AS latest_title, coalesce(l.link, '') AS latest_url, coalesce(l.canonical_key, '') AS latest_canonical_key,
         l.gaps AS latest_gaps
  FROM dimension d LEFT JOIN article_counts a ON a.source = d.name LEFT JOIN event_counts e ON e.source = d.name LEFT JOIN latest l ON l.source = d.name
),
rows_v AS MATERIALIZED (
  SELECT *, round(age, 2) AS age_days,
         CASE WHEN NOT enabled THEN 'skipped_disabled' WHEN NOT tracked THEN 'not_tracked' WHEN article_count = 0 THEN 'missing'
              WHEN event_count = 0 THEN 'missing_event' WHEN age IS NULL THEN 'unknown_event_date'
              WHEN freshness_sla_days IS NOT NULL AND age > freshness_sla_days THEN 'stale' ELSE 'fresh' END AS status
  FROM aged
),
models(position, event_model) AS (VALUES (0, 'paper_release'), (1, 'citation_snapshot'), (2, 'code_repository'), (3, 'benchmark_result'), (4, 'weather_context')),
backlog(position, name, signal_type, gate) AS (VALUES (0, 'Citation service', 'citation_snapshot', 'key mapping'), (1, 'Result board', 'benchmark_result', 'terms')),
items AS (
  SELECT * FROM (
    SELECT 0 AS section, event_at, link, event_key AS k, 0 AS part, 0 AS position, 'missing_required_fields' AS reason, event_model, source, title, event_key,
           NULL AS canonical_key, gaps, NULL AS latest_title, NULL::DOUBLE AS age_days, NULL AS activation_gate FROM events_v WHERE gaps <> ''
    UNION ALL
    SELECT 0, event_at, link, event_key, 1, 0, 'title_proxy_canonical_key', event_model, source, title, event_key, canonical_key, NULL, NULL, NULL, NULL
    FROM events_v WHERE canonical_key_status = 'title_proxy'
    UNION ALL
    SELECT 1, NULL, '', '', 0, position, 'source_' || status, event_model, source, NULL, NULL, NULL, NULL, latest_title, age_days, NULL
    FROM rows_v WHERE tracked AND status IN ('missing', 'missing_event', 'unknown_event_date', 'stale')
    UNION ALL
    SELECT 2, NULL, '', '', 0, position, 'missing_event_model', event_model, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM models WHERE event_model NOT IN (SELECT event_model FROM events_v)
    UNION ALL
    SELECT 3, NULL, '', '', 0, position, 'source_backlog_pending', signal_type, name, NULL, NULL, NULL, NULL, NULL, NULL, gate FROM backlog)
)"""
)


def _events(spark, folder):
    return ops.build_events(signals_view(spark, folder), sources_view(spark, folder), SETTINGS)


def _stored_events(spark, folder):
    """Events written once, for queries that read them more than once."""
    place = shared_folder(spark, "events")
    _events(spark, folder).write.parquet(place)
    return spark.read.parquet(place)


def _source_rows(spark, folder, rollup, errors=None):
    articles, sources = signals_view(spark, folder), sources_view(spark, folder)
    counts = health.article_counts(articles)
    return health.source_rows(sources, counts, rollup, SETTINGS, as_of=AS_OF, errors=errors)


@register(f"WITH {FIELDS} SELECT doc_id, coalesce(f_arxiv, '') AS arxiv, coalesce(f_doi, '') AS doi, coalesce(f_repository, '') AS repository, "
          "coalesce(f_citations, '') AS citations, coalesce(f_benchmark, '') AS benchmark, metric_name, coalesce(metric_value, '') AS metric_value FROM fields_v")
def labelled_values(spark, folder):
    rows = signals_view(spark, folder).withColumn("fields", labelled_fields("title", "summary"))
    return rows.select(
        "doc_id",
        field("fields", "arXiv").alias("arxiv"),
        field("fields", "DOI").alias("doi"),
        field("fields", "Repository", "Repo", "GitHub repository").alias("repository"),
        field("fields", "Citation count", "Citations").alias("citations"),
        field("fields", "Benchmark", "Benchmark name").alias("benchmark"),
        field("fields", "Metric", "Metric name", "Score").alias("metric_name"),
        field("fields", "Metric value", "Score").alias("metric_value"),
    )


@register(f"""WITH {FIELDS}, r AS (SELECT *, CASE WHEN coalesce(f_repository, '') <> '' THEN f_repository
  WHEN free_owner <> '' THEN 'github.com/' || free_owner || '/' || free_name ELSE '' END AS repository FROM ids_v)
SELECT doc_id, arxiv_id, doi, repository, split_part(repository, '/', 1) AS repository_host, split_part(repository, '/', 2) AS repository_owner,
       split_part(repository, '/', 3) AS repository_name, citation_count, benchmark_name, metric_name, metric_value, normalized_title,
       coalesce(nullif(doi, ''), nullif(arxiv_id, ''), nullif(link, ''), normalized_title) AS paper_id FROM r""")
def identifiers(spark, folder):
    rows = ops.with_identifiers(signals_view(spark, folder))
    return rows.select(
        "doc_id", "arxiv_id", "doi", "repository", "repository_host", "repository_owner", "repository_name",
        "citation_count", "benchmark_name", "metric_name", "metric_value", "normalized_title", "paper_id",
    )


@register(f"WITH {EVENTS} SELECT link AS url, event_model, canonical_key, canonical_key_status FROM events_v")
def canonical_keys(spark, folder):
    return _events(spark, folder).select("url", "event_model", "canonical_key", "canonical_key_status")


@register(f"WITH {EVENTS} SELECT link AS url, source, event_key, normalized_title FROM events_v")
def event_keys(spark, folder):
    return _events(spark, folder).select("url", "source", "event_key", "normalized_title")


@register(f"WITH {EVENTS} SELECT link AS url, event_model, gaps FROM events_v")
def required_gaps(spark, folder):
    return _events(spark, folder).select("url", "event_model", F.array_join("required_field_gaps", ",").alias("gaps"))


@register(f"""WITH {EVENTS} SELECT source, source_type, trust_tier, event_model, title, link AS url, coalesce(nullif(link, ''), home) AS source_url,
  {stamp_sql('event_at')} AS event_at, event_key, paper_id, arxiv_id, doi, repository, host AS repository_host, owner AS repository_owner,
  name AS repository_name, citation_count, benchmark_name, metric_name, metric_value, canonical_key, canonical_key_status, gaps FROM events_v""")
def events_built(spark, folder):
    rows = _events(spark, folder).withColumns(
        {"event_at": stamp("event_at"), "gaps": F.array_join("required_field_gaps", ",")}
    )
    return rows.select(
        "source", "source_type", "trust_tier", "event_model", "title", "url", "source_url", "event_at", "event_key",
        "paper_id", "arxiv_id", "doi", "repository", "repository_host", "repository_owner", "repository_name",
        "citation_count", "benchmark_name", "metric_name", "metric_value", "canonical_key", "canonical_key_status", "gaps",
    )


@register(f"""WITH {SIGNALS}, {SOURCES} SELECT link, round(greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(
  CASE WHEN d.event_model = 'citation_snapshot' AND collected_at IS NOT NULL THEN collected_at ELSE coalesce(published, collected_at) END
  ))::DOUBLE / 86400000000.0), 6) AS age_days FROM signals_v JOIN dimension d ON d.name = source""")
def event_age(spark, folder):
    models = ops.source_models(sources_view(spark, folder), TRACKED).select(col("name").alias("source"), "event_model")
    rows = signals_view(spark, folder).join(models, "source")
    return rows.select("link", F.round(age_in_days(F.lit(AS_OF), ops.event_time()), 6).alias("age_days"))


@register(f"WITH {SOURCES} SELECT name, event_model, tracked, freshness_sla_days FROM dimension")
def source_models(spark, folder):
    rows = ops.source_models(sources_view(spark, folder), TRACKED)
    return rows.select("name", "event_model", "tracked", ops.freshness_limit(SETTINGS).alias("freshness_sla_days"))


_ROW = (
    "source, enabled, tracked, event_model, freshness_sla_days, status, article_count, event_count, age_days, latest_title, latest_url, "
    "latest_canonical_key, skip_reason"
)


@register(f"WITH {HEALTH} SELECT {_ROW}, {stamp_sql('latest_event_at')} AS latest_event_at, coalesce(latest_gaps, '') AS latest_gaps FROM rows_v")
def source_freshness(spark, folder):
    rows = _source_rows(spark, folder, health.event_rollup(_stored_events(spark, folder)))
    gaps = F.coalesce(F.array_join("latest_required_field_gaps", ","), F.lit(""))
    return rows.select(
        *_ROW.split(", "), stamp("latest_event_at"), gaps.alias("latest_gaps")
    )


@register(f"""WITH {HEALTH} SELECT count(*) AS research_signal_event_count,
  count(*) FILTER (event_model IN ('paper_release', 'citation_snapshot') AND starts_with(canonical_key, 'paper:')) AS paper_canonical_key_present_count,
  count(*) FILTER (event_model = 'code_repository' AND starts_with(canonical_key, 'repository:')) AS repository_canonical_key_present_count,
  count(*) FILTER (event_model = 'benchmark_result' AND starts_with(canonical_key, 'benchmark:')) AS benchmark_canonical_key_present_count,
  count(*) FILTER (canonical_key_status = 'title_proxy') AS title_proxy_key_count, count(*) FILTER (canonical_key_status = 'missing') AS missing_canonical_key_count,
  count(citation_count) AS citation_count_present_count, count(*) FILTER (repository <> '') AS code_repository_present_count,
  count(*) FILTER (benchmark_name <> '' AND metric_name <> '' AND metric_value <> '') AS benchmark_metric_present_count,
  sum(CASE WHEN gaps = '' THEN 0 ELSE len(string_split(gaps, ',')) END)::BIGINT AS event_required_field_gap_count,
  (SELECT count(*) FROM rows_v WHERE tracked AND status IN ('missing', 'missing_event', 'unknown_event_date', 'stale')) AS tracked_source_gap_count,
  (SELECT count(*) FROM models WHERE event_model NOT IN (SELECT event_model FROM events_v)) AS missing_event_model_count,
  2 AS source_backlog_candidate_count FROM events_v""")
def event_quality_summary(spark, folder):
    events = _stored_events(spark, folder)
    rows = _source_rows(spark, folder, health.event_rollup(events))
    return health.event_summary(health.event_counts(events), rows, SETTINGS)


@register(f"""WITH {HEALTH}, s(status) AS (VALUES ('fresh'), ('stale'), ('missing'), ('missing_event'), ('unknown_event_date'), ('not_tracked'), ('skipped_disabled'))
SELECT 'status' AS kind, s.status AS name, count(r.source) AS n FROM s LEFT JOIN rows_v r USING (status) GROUP BY s.status
UNION ALL SELECT 'model', m.event_model, count(e.source) FROM models m LEFT JOIN events_v e USING (event_model) GROUP BY m.event_model""")
def status_histogram(spark, folder):
    events = _stored_events(spark, folder)
    statuses = health.status_histogram(_source_rows(spark, folder, health.event_rollup(events)))
    models = health.model_histogram(health.event_counts(events), SETTINGS)
    return statuses.select(F.lit("status").alias("kind"), col("status").alias("name"), "n").unionByName(
        models.select(F.lit("model").alias("kind"), col("event_model").alias("name"), "n")
    )


_ORDER = "ORDER BY section, event_at DESC NULLS LAST, link, k, part, position"


@register(f"WITH {HEALTH} SELECT section, reason, event_model, source, title, event_key, canonical_key, gaps, latest_title, age_days, activation_gate "
          f"FROM items {_ORDER} LIMIT 50")
def review_items(spark, folder):
    return _review(spark, folder, 50).select(
        "section", "reason", "event_model", "source", "title", "event_key", "canonical_key",
        F.array_join("required_field_gaps", ",").alias("gaps"), "latest_title", "age_days", "activation_gate",
    )


@register(f"WITH {HEALTH} SELECT section, reason, event_model, source, title, event_key, canonical_key, gaps, latest_title, age_days, activation_gate "
          f"FROM items")
def review_items_all(spark, folder):
    """All sections, without a cut."""
    return _review(spark, folder, None).select(
        "section", "reason", "event_model", "source", "title", "event_key", "canonical_key",
        F.array_join("required_field_gaps", ",").alias("gaps"), "latest_title", "age_days", "activation_gate",
    )


def _review(spark, folder, limit):
    events = _stored_events(spark, folder)
    counts = health.event_counts(events)
    rows = _source_rows(spark, folder, health.event_rollup(events))
    return health.review_items(events, counts, rows, backlog_table(spark, SETTINGS), SETTINGS, limit=limit)


@register(f"WITH {HEALTH} SELECT event_model, position FROM models WHERE event_model NOT IN (SELECT event_model FROM events_v)")
def missing_models(spark, folder):
    return ops.missing_models(_events(spark, folder), SETTINGS).select("event_model", "position")


@register(f"""WITH {HEALTH}, first_events AS (SELECT * FROM events_v ORDER BY event_at DESC NULLS LAST, link, event_key LIMIT 8),
first_items AS (SELECT * FROM (SELECT * FROM items {_ORDER} LIMIT 50) {_ORDER} LIMIT 8)
SELECT 'event' AS part, event_model, source, canonical_key AS detail, coalesce(citation_count::VARCHAR, '') AS value FROM first_events
UNION ALL SELECT 'review', coalesce(event_model, ''), coalesce(source, ''),
  coalesce(replace(gaps, ',', ', '), nullif(activation_gate, ''), nullif(canonical_key, ''), nullif(latest_title, ''), nullif(title, ''), ''), reason FROM first_items
UNION ALL SELECT 'figure', '', '', 'events', (SELECT count(*) FROM events_v)::VARCHAR
UNION ALL SELECT 'figure', '', '', 'paper keys', (SELECT count(*) FROM events_v WHERE event_model IN ('paper_release', 'citation_snapshot') AND starts_with(canonical_key, 'paper:'))::VARCHAR
UNION ALL SELECT 'figure', '', '', 'repo keys', (SELECT count(*) FROM events_v WHERE event_model = 'code_repository' AND starts_with(canonical_key, 'repository:'))::VARCHAR
UNION ALL SELECT 'figure', '', '', 'bench keys', (SELECT count(*) FROM events_v WHERE event_model = 'benchmark_result' AND starts_with(canonical_key, 'benchmark:'))::VARCHAR
UNION ALL SELECT 'figure', '', '', 'field gaps', (SELECT sum(CASE WHEN gaps = '' THEN 0 ELSE len(string_split(gaps, ',')) END)::BIGINT FROM events_v)::VARCHAR
UNION ALL SELECT 'figure', '', '', 'review', (SELECT count(*) FROM (SELECT * FROM items LIMIT 50))::VARCHAR""")
def quality_panel(spark, folder):
    events = _stored_events(spark, folder)
    counts = health.event_counts(events)
    rows = _source_rows(spark, folder, health.event_rollup(events))
    items = health.review_items(events, counts, rows, backlog_table(spark, SETTINGS), SETTINGS)
    blank = F.lit("")
    shown = health.event_panel(events).select(
        F.lit("event").alias("part"), "event_model", "source", col("canonical_key").alias("detail"), col("citations").alias("value")
    )
    review = health.review_panel(items).select(
        F.lit("review").alias("part"), "event_model", "source", "detail", col("reason").alias("value")
    )
    figures = health.headline_counts(health.event_summary(counts, rows, SETTINGS), items).select(
        F.lit("figure").alias("part"), blank.alias("event_model"), blank.alias("source"), col("figure").alias("detail"),
        col("value").cast("string").alias("value"),
    )
    return shown.unionByName(review).unionByName(figures)


@register(f"""WITH {SOURCES}, messages AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ': timeout at 10:30: again' WHEN 1 THEN source || '0: failed' WHEN 2 THEN 'no source' ELSE source || ' late: x' END AS message FROM documents)
SELECT s.name AS source, m.message, count(*) AS n FROM messages m JOIN sources_v s ON starts_with(m.message, s.name || ':') GROUP BY ALL""")
def error_prefix_join(spark, folder):
    n = col("doc_id") % 4
    message = (
        F.when(n == 0, F.concat("source", F.lit(": timeout at 10:30: again")))
        .when(n == 1, F.concat("source", F.lit("0: failed")))
        .when(n == 2, F.lit("no source"))
        .otherwise(F.concat("source", F.lit(" late: x")))
    )
    errors = table(spark, folder, "documents").select(message.alias("message"))
    found = health.source_errors(errors, sources_view(spark, folder))
    return found.groupBy("source", "message").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {MESSAGES} SELECT link, source, link || ': ' || concat_ws(', ', m1, m2, m3, m4) AS message FROM parts
WHERE concat_ws(', ', m1, m2, m3, m4) <> ''""")
def validation_errors(spark, folder):
    """Every invalid row with its whole message."""
    return error_rows(dirty_view(spark, folder)).select("link", "source", "message")


@register(ORACLES["validation_errors"])
def validation_errors_all(spark, folder):
    """The same; the name is kept from when ``validation_errors`` had a cut."""
    return validation_errors(spark, folder)


@register(f"""WITH {MESSAGES} SELECT source, m.message, count(*) AS n FROM parts, unnest([m1, m2, m3, m4]) AS m(message)
WHERE m.message IS NOT NULL AND NOT starts_with(m.message, 'link has') GROUP BY ALL
UNION ALL SELECT source, 'link has invalid URL format', count(*) FROM parts WHERE starts_with(m2, 'link has') GROUP BY source""")
def fault_counts(spark, folder):
    """How often each fault stands in the messages of a source's invalid rows."""
    rows = error_rows(dirty_view(spark, folder))
    faults = F.split(F.regexp_replace("message", "link has invalid URL format: [^,]*", "link has invalid URL format"), ", ")
    each = rows.select("source", F.explode(faults).alias("fault"))
    message = F.regexp_extract("fault", "((title|link|summary|source) (is|has) .*)$", 1)
    return each.select("source", message.alias("message")).groupBy("source", "message").agg(F.count(F.lit(1)).alias("n"))


#: The same chain over the rows of the look-back window.
_WINDOWED = HEALTH.replace(
    "FROM signals_v",
    "FROM (SELECT s.* FROM signals_v s, (SELECT max(coalesce(published, collected_at))::DATE AS newest FROM signals_v) m "
    f"WHERE coalesce(published, collected_at) >= {AS_OF_SQL} - to_days(greatest(14, coalesce(date_diff('day', newest, {AS_OF_SQL}::DATE) + 1, 14))::INT))",
)


@register(f"""WITH {_WINDOWED} SELECT 'events' AS section, count(*) AS n FROM events_v UNION ALL SELECT 'sources', count(*) FROM rows_v
UNION ALL SELECT 'review', least(count(*), 50) FROM items
UNION ALL SELECT * FROM (VALUES ('summary', 1), ('statuses', 7), ('models', 5), ('backlog', 2), ('missing', 4), ('duplicates', 1), ('dates', 1))""")
def quality_run(spark, folder):
    """The stand-alone report over stored rows: every section with its number of rows."""
    articles = signals_view(spark, folder).withColumn("category", F.lit("research"))
    report = stored_quality_run(
        articles, sources_view(spark, folder), SETTINGS, category="research", as_of=AS_OF
    )
    rows = None
    for name, section in report.items():
        count = section.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n"))
        rows = count if rows is None else rows.unionByName(count)
    return rows


@register(ORACLES["status_histogram"])
def report_sink(spark, folder):
    """Sections of a report written for the day and as the latest, and read back from there."""
    events = _stored_events(spark, folder)
    sections = {
        "statuses": health.status_histogram(_source_rows(spark, folder, health.event_rollup(events))),
        "models": health.model_histogram(health.event_counts(events), SETTINGS),
    }
    places = write_report(sections, shared_folder(spark, "reports"), as_of=AS_OF)
    read = {n: spark.read.schema(t.schema).json(f"{places['latest']}/{n}") for n, t in sections.items()}
    return read["statuses"].select(F.lit("status").alias("kind"), col("status").alias("name"), "n").unionByName(
        read["models"].select(F.lit("model").alias("kind"), col("event_model").alias("name"), "n")
    )


@register(f"WITH {SIGNALS} SELECT 'none stored' AS kind, link, source FROM signals_v UNION ALL SELECT 'stored', link, source FROM signals_v "
          f"WHERE category = 'en' AND collected_at >= {AS_OF_SQL} - INTERVAL 3 DAY")
def window_fallback(spark, folder):
    """The recent stored rows of a category, and the rows of the run where there are none."""
    rows = signals_view(spark, folder)
    out = []
    for kind, as_of in (("none stored", AS_OF + dt.timedelta(days=900)), ("stored", AS_OF)):
        window = quality_window(rows, rows, category="en", as_of=as_of, days=3, limit=None)
        out.append(window.select(F.lit(kind).alias("kind"), "link", "source"))
    return out[0].unionByName(out[1])
