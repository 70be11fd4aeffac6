"""Freshness and quality of the sources.

:func:`event_counts` reduces the events to one row per source before the shuffle, so a source that holds a
large part of all rows costs no more there than a small one. All counts come from that small table;
:func:`event_rollup` fetches the latest event of each source on top of it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_in_days
from ..functions.text import col, text_or_empty
from ..sources.config import QualitySettings
from ..sources.tables import newest_per_key
from .signals import freshness_limit, missing_models, source_models

# Source states, and those that call for a review.
STATUSES = [
    "fresh",
    "stale",
    "missing",
    "missing_event",
    "unknown_event_date",
    "not_tracked",
    "skipped_disabled",
]
PROBLEM_STATUSES = ("missing", "missing_event", "unknown_event_date", "stale")

REVIEW_LIMIT = 50

_REVIEW = [
    "section",
    "position",
    "reason",
    "event_model",
    "source",
    "title",
    "event_key",
    "canonical_key",
    "required_field_gaps",
    "latest_title",
    "age_days",
    "activation_gate",
]


def _age() -> Column:
    """Orders events from the newest to the undated."""
    return F.coalesce(-F.unix_micros("event_at"), F.lit((1 << 63) - 1))


def event_counts(events: DataFrame) -> DataFrame:
    """Counts per source and the ``age`` of its newest event; all of fixed width, so a hash aggregate holds them."""

    def key_count(prefix: str, *models: str) -> Column:
        return F.count_if(col("event_model").isin(*models) & col("canonical_key").startswith(prefix))

    def filled(name: str) -> Column:
        return F.coalesce(col(name) != "", F.lit(False))

    return events.groupBy("source", "event_model").agg(
        F.count(F.lit(1)).alias("event_count"),
        key_count("paper:", "paper_release", "citation_snapshot").alias("paper_keys"),
        key_count("repository:", "code_repository").alias("repository_keys"),
        key_count("benchmark:", "benchmark_result").alias("benchmark_keys"),
        F.count_if(col("canonical_key_status") == "title_proxy").alias("title_proxy_keys"),
        F.count_if(col("canonical_key_status") == "missing").alias("missing_keys"),
        F.count("citation_count").alias("citation_counts"),
        F.count_if(filled("repository")).alias("repositories"),
        F.count_if(filled("benchmark_name") & filled("metric_name") & filled("metric_value")).alias("results"),
        F.sum(F.size("required_field_gaps")).alias("field_gaps"),
        F.min(_age()).alias("age"),
    )


def event_rollup(events: DataFrame) -> DataFrame:
    """:func:`event_counts` and the latest event per source; the newest dated event, on ties the smallest URL.

    The counts tell the newest time. Only the events of that time meet them, and of several the first is picked.
    """
    latest = F.struct(
        "event_at",
        "title",
        "url",
        "required_field_proxy",
        "canonical_key",
        "required_field_gaps",
    )
    rows = events.select(
        col("source").alias("_source"), col("event_model").alias("_model"), _age().alias("_age"), "event_key", latest.alias("latest")
    )
    same = [col(a).eqNullSafe(col(b)) for a, b in (("source", "_source"), ("event_model", "_model"), ("age", "_age"))]
    newest = event_counts(events).join(rows, same)
    first = newest_per_key(newest, ["source", "event_model"], col("latest.url"), col("event_key"))
    return first.drop("_source", "_model", "_age", "event_key", "age")


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count(F.lit(1)).alias("article_count"))


def source_errors(errors: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, message`` for every message that starts with ``<source name>:``.

    A message offers its parts before a colon, so the prefix test is a join by equality; it offers no more of them than
    the name with the most colons has, so a long message costs the length of its start.
    """
    most = sources.agg(F.coalesce(F.max(F.size(F.split("name", ":"))), F.lit(1))).scalar()
    cuts = F.sequence(F.lit(1), F.least(F.size(F.split("message", ":")) - 1, most))
    parted = errors.select("message").where(col("message").contains(":"))
    offered = parted.select("message", F.explode(cuts).alias("n"))
    offered = offered.withColumn("source", F.expr("substring_index(message, ':', n)"))
    return offered.join(sources.select(col("name").alias("source")), "source").select("source", "message")


def source_rows(
    sources: DataFrame,
    counts: DataFrame,
    rollup: DataFrame,
    settings: QualitySettings,
    *,
    as_of: dt.datetime,
    errors: DataFrame | None = None,
) -> DataFrame:
    """One row per configured source with its counts, latest event, age and status."""
    dimension = source_models(sources, settings.tracked_models).withColumn("freshness_sla_days", freshness_limit(settings))
    rows = dimension.withColumnRenamed("name", "source")
    rows = rows.join(counts, "source", "left")
    rows = rows.join(rollup.drop("event_model"), "source", "left")
    if errors is None:
        rows = rows.withColumn("error_count", F.lit(0).cast("bigint"))
    else:
        per_source = source_errors(errors, sources).groupBy("source").agg(F.count(F.lit(1)).alias("error_count"))
        rows = rows.join(per_source, "source", "left")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns(
        {
            "article_count": F.coalesce("article_count", zero),
            "event_count": F.coalesce("event_count", zero),
            "error_count": F.coalesce("error_count", zero),
            "age": age_in_days(F.lit(as_of), "latest.event_at"),
        }
    )
    rows = rows.withColumn("age", F.when(col("latest.event_at").isNotNull(), col("age")))
    status = (
        F.when(~col("enabled"), "skipped_disabled")
        .when(~col("tracked"), "not_tracked")
        .when(col("article_count") == 0, "missing")
        .when(col("event_count") == 0, "missing_event")
        .when(col("age").isNull(), "unknown_event_date")
        .when(col("freshness_sla_days").isNotNull() & (col("age") > col("freshness_sla_days")), "stale")
        .otherwise("fresh")
    )

    def latest(name: str) -> Column:
        return text_or_empty(F.col("latest")[name])

    def setting(name: str) -> Column:
        return text_or_empty(F.try_element_at(col("config"), F.lit(name)))

    return rows.select(
        "position",
        "source",
        col("type").alias("source_type"),
        "enabled",
        "trust_tier",
        "content_type",
        "collection_tier",
        "producer_role",
        "info_purpose",
        "tracked",
        "event_model",
        "freshness_sla_days",
        status.alias("status"),
        "article_count",
        "event_count",
        col("latest.event_at").alias("latest_event_at"),
        F.round("age", 2).alias("age_days"),
        latest("title").alias("latest_title"),
        latest("url").alias("latest_url"),
        F.col("latest.required_field_proxy").alias("latest_required_field_proxy"),
        latest("canonical_key").alias("latest_canonical_key"),
        F.col("latest.required_field_gaps").alias("latest_required_field_gaps"),
        setting("skip_reason").alias("skip_reason"),
        setting("reenable_gate").alias("reenable_gate"),
        "error_count",
    )


def status_histogram(rows: DataFrame) -> DataFrame:
    """Sources per status, zero for a status that does not occur."""
    counts = rows.agg(*[F.count_if(col("status") == s).alias(s) for s in STATUSES])
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), col(s).alias("n")) for s in STATUSES])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def model_histogram(event_counts: DataFrame, settings: QualitySettings) -> DataFrame:
    """Events per tracked model, zero for a model that does not occur."""
    spark = event_counts.sparkSession
    models = spark.createDataFrame(list(enumerate(settings.tracked_models)), "position int, event_model string")
    counts = event_counts.groupBy("event_model").agg(F.sum("event_count").alias("n"))
    joined = models.join(counts, "event_model", "left")
    return joined.select("event_model", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def event_summary(event_counts: DataFrame, rows: DataFrame, settings: QualitySettings) -> DataFrame:
    """The thirteen event-quality counts as one row."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    counts = event_counts.agg(
        total("event_count").alias("research_signal_event_count"),
        total("paper_keys").alias("paper_canonical_key_present_count"),
        total("repository_keys").alias("repository_canonical_key_present_count"),
        total("benchmark_keys").alias("benchmark_canonical_key_present_count"),
        total("title_proxy_keys").alias("title_proxy_key_count"),
        total("missing_keys").alias("missing_canonical_key_count"),
        total("citation_counts").alias("citation_count_present_count"),
        total("repositories").alias("code_repository_present_count"),
        total("results").alias("benchmark_metric_present_count"),
        total("field_gaps").alias("event_required_field_gap_count"),
        F.collect_set("event_model").alias("_models"),
    )
    gap = rows.agg(F.count_if(col("tracked") & col("status").isin(*PROBLEM_STATUSES)).alias("n"))
    tracked = F.array(*[F.lit(m) for m in settings.tracked_models]).cast("array<string>")
    return counts.select(
        "*",
        gap.scalar().alias("tracked_source_gap_count"),
        F.size(F.array_except(tracked, col("_models"))).cast("bigint").alias("missing_event_model_count"),
        F.lit(len(settings.backlog)).cast("bigint").alias("source_backlog_candidate_count"),
    ).drop("_models")


def review_items(
    events: DataFrame,
    event_counts: DataFrame,
    rows: DataFrame,
    backlog: DataFrame,
    settings: QualitySettings,
    *,
    limit: int | None = REVIEW_LIMIT,
) -> DataFrame:
    """What a person should look at: field gaps and weak keys of events, source problems, models without
    events, sources still to come. Cut to ``limit`` over all sections, in order; without a limit all rows, in no order.
    """
    gaps = F.when(F.size("required_field_gaps") > 0, F.lit("missing_required_fields"))
    weak = F.when(col("canonical_key_status") == "missing", F.lit("missing_canonical_key")).when(
        col("canonical_key_status") == "title_proxy", F.lit("title_proxy_canonical_key")
    )
    flagged = events.select(
        "event_model",
        "source",
        "title",
        "event_key",
        "event_at",
        "url",
        "canonical_key",
        "required_field_gaps",
        F.posexplode(F.array(gaps, weak)).alias("part", "reason"),
    ).where("reason is not null")
    is_gap, is_proxy = col("part") == 0, col("reason") == "title_proxy_canonical_key"
    order = [col("event_at").desc_nulls_last(), col("url"), col("event_key"), col("part")]
    # Only `limit` rows of this section can remain, so each task keeps its own first `limit`.
    first_events = flagged if limit is None else flagged.orderBy(*order).limit(limit)
    numbered = first_events.select(
        F.lit(0).alias("section"),
        F.struct(
            F.coalesce(-F.unix_micros("event_at"), F.lit((1 << 63) - 1)).alias("a"),
            col("url").alias("b"),
            col("event_key").alias("c"),
            col("part").alias("d"),
        ).alias("position"),
        "reason",
        "event_model",
        "source",
        "title",
        "event_key",
        F.when(is_proxy, col("canonical_key")).alias("canonical_key"),
        F.when(is_gap, col("required_field_gaps")).alias("required_field_gaps"),
    )

    def place(position: Column) -> Column:
        return F.struct(
            position.cast("bigint").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit(0).alias("d")
        )

    problems = rows.where(col("tracked") & col("status").isin(*PROBLEM_STATUSES)).select(
        F.lit(1).alias("section"),
        place(col("position")).alias("position"),
        F.concat(F.lit("source_"), col("status")).alias("reason"),
        "event_model",
        "source",
        "latest_title",
        "age_days",
    )
    absent = missing_models(event_counts, settings).select(
        F.lit(2).alias("section"),
        place(col("position")).alias("position"),
        F.lit("missing_event_model").alias("reason"),
        "event_model",
    )
    pending = backlog.select(
        F.lit(3).alias("section"),
        place(col("position")).alias("position"),
        F.lit("source_backlog_pending").alias("reason"),
        col("signal_type").alias("event_model"),
        col("name").alias("source"),
        "activation_gate",
    )
    items = numbered
    for part in (problems, absent, pending):
        items = items.unionByName(part, allowMissingColumns=True)
    items = items.select(*_REVIEW)
    return items if limit is None else items.orderBy("section", "position").limit(limit)


def review_panel(items: DataFrame, *, limit: int = 8) -> DataFrame:
    """First review items with one detail column."""
    detail = F.when(
        col("required_field_gaps").isNotNull(), F.array_join("required_field_gaps", ", ")
    ).otherwise(
        F.coalesce(
            *[F.nullif(col(c), F.lit("")) for c in ("activation_gate", "canonical_key", "latest_title", "title")],
            F.lit(""),
        )
    )
    first = items.orderBy("section", "position").limit(limit)
    return first.select(
        "reason", text_or_empty("event_model").alias("event_model"), text_or_empty("source").alias("source"),
        detail.alias("detail"),
    )


def event_panel(events: DataFrame, *, limit: int = 8) -> DataFrame:
    """Newest events with their key and citations."""
    first = events.orderBy(col("event_at").desc_nulls_last(), "url", "event_key").limit(limit)
    return first.select("event_model", "source", "canonical_key", text_or_empty("citation_count").alias("citations"))


def headline_counts(summary: DataFrame, items: DataFrame) -> DataFrame:
    """The six figures shown on top of the quality panel."""
    review = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = [
        ("events", col("research_signal_event_count")),
        ("paper keys", col("paper_canonical_key_present_count")),
        ("repo keys", col("repository_canonical_key_present_count")),
        ("bench keys", col("benchmark_canonical_key_present_count")),
        ("field gaps", col("event_required_field_gap_count")),
        ("review", col("review")),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("figure"), c.alias("value")) for n, c in pairs])
    return summary.withColumn("review", review).select(F.explode(entries).alias("e")).select("e.*")
