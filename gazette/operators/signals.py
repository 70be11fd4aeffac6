"""Typed signal events from articles: event model, identifiers, canonical keys and required-field gaps.

Every step is a projection of the article row, after one join with the source dimension. The dimension is
not hinted: Catalyst broadcasts it when its known size is under the broadcast threshold and otherwise joins
by shuffle, where skewed sources are split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.labelled import field, labelled_fields
from ..functions.text import blank_to_null, col, first_filled, short_digest, slug, text_or_empty, title_key
from ..functions.urls import split_url
from ..sources.config import QualitySettings

# Token in the description of a source -> event model, tried in this order.
MODEL_TOKENS = [
    ("benchmark", "benchmark_result"),
    ("leaderboard", "benchmark_result"),
    ("citation", "citation_snapshot"),
    ("repository", "code_repository"),
    ("github", "code_repository"),
    ("code", "code_repository"),
    ("preprint", "paper_release"),
    ("academic", "paper_release"),
    ("research", "paper_release"),
    ("transaction", "transaction_record"),
    ("price", "transaction_record"),
    ("presale", "presale_competition"),
    ("competition", "presale_competition"),
    ("listing", "listing_inventory"),
    ("inventory", "listing_inventory"),
    ("permit", "permit_completion"),
    ("completion", "permit_completion"),
    ("reservation", "reservation_slot"),
    ("slot", "reservation_slot"),
    ("ticket", "ticket_price"),
    ("weather", "weather_context"),
]
WAIT_TIME_MODEL = "wait_time_snapshot"

# Configuration entries of a source that name its repository.
REPOSITORY_SETTINGS = ("repository", "canonical_repository", "github_repository")

# Columns that also satisfy a required field.
FIELD_COLUMNS = {
    "paper_id": ("paper_id", "arxiv_id", "doi", "normalized_title"),
    "source_url": ("source_url", "url"),
}
CURRENCY_TOKENS = ("usd", "krw", "$", "원")

_OPTIONAL = {
    "doi": "string",
    "arxiv_id": "string",
    "venue": "string",
    "abstract": "string",
    "citation_count": "int",
    "matched_entities": "map<string,array<string>>",
}


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _setting(name: str) -> Column:
    return F.try_element_at(col("config"), F.lit(name))


def source_models(sources: DataFrame, tracked: Sequence[str]) -> DataFrame:
    """Source dimension with ``event_model`` (empty when no rule applies) and ``tracked``."""
    models = _strings(tracked)
    purpose = F.get(F.filter(col("info_purpose"), lambda p: F.array_contains(models, p)), F.lit(0))
    text = F.lower(
        F.concat_ws(
            " ",
            *[text_or_empty(c) for c in ("name", "type", "content_type", "collection_tier", "producer_role")],
            F.array_join("info_purpose", " "),
            F.array_join(F.map_values("config"), " "),
        )
    )
    rule = F.when(F.lit(WAIT_TIME_MODEL in tracked) & (F.lower("type") == "api"), F.lit(WAIT_TIME_MODEL))
    for token, model in MODEL_TOKENS:
        if model in tracked:
            rule = rule.when(text.contains(token), F.lit(model))
    model = F.coalesce(blank_to_null(F.trim(_setting("event_model"))), purpose, rule, F.lit(""))
    return sources.withColumn("event_model", model).withColumn("tracked", F.array_contains(models, col("event_model")))


def freshness_limit(settings: QualitySettings) -> Column:
    """Days allowed: of the source, else ``<model>_days``, ``_day``, ``_hours`` / 24 or ``_hour`` / 24."""
    tries = [F.trim(_setting("freshness_sla_days")).try_cast("double")]
    if settings.freshness:
        limits = F.create_map(*[F.lit(v) for k, n in settings.freshness.items() for v in (k, float(n))])
        for unit, divisor in (("days", 1.0), ("day", 1.0), ("hours", 24.0), ("hour", 24.0)):
            tries.append(F.try_element_at(limits, F.concat(col("event_model"), F.lit("_" + unit))) / F.lit(divisor))
    return F.coalesce(*tries)


def with_optional_columns(articles: DataFrame) -> DataFrame:
    """Add the columns that only papers have as NULL."""
    missing = {n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in articles.columns}
    return articles.withColumns(missing) if missing else articles


def article_time() -> Column:
    return F.coalesce(col("published"), col("collected_at"))


def event_time() -> Column:
    """Collection time for citation snapshots, else publication, else collection time."""
    by_collection = (col("event_model") == "citation_snapshot") & col("collected_at").isNotNull()
    return F.when(by_collection, col("collected_at")).otherwise(article_time())


def _summary() -> Column:
    return F.coalesce(blank_to_null("summary"), blank_to_null("abstract"), F.lit(""))


def with_identifiers(
    articles: DataFrame, *, configured_repository: Column | None = None, title_chars: int | None = 96
) -> DataFrame:
    """Articles with the labelled fields (``fields``) and every identifier column read from them.

    Title keys have at most ``title_chars`` characters; with None they are whole.
    """
    rows = with_optional_columns(articles)
    rows = rows.withColumn("_summary", _summary())
    rows = rows.withColumn("fields", labelled_fields("title", "_summary"))
    f, title, link = "fields", text_or_empty("title"), text_or_empty("link")
    configured = F.lit("") if configured_repository is None else configured_repository
    # One column per step: what a step reads more than once is computed once.
    rows = rows.withColumns(
        {
            "_arxiv": field(f, "arXiv"),
            "_doi": field(f, "DOI"),
            "_repo": field(f, "Repository", "Repo", "GitHub repository"),
            "_cited": field(f, "Citation count", "Citations"),
            "_benchmark": field(f, "Benchmark", "Benchmark name"),
            "metric_name": field(f, "Metric", "Metric name", "Score"),
            "_metric": field(f, "Metric value", "Score"),
            "dataset": field(f, "Dataset"),
            "normalized_title": title_key(title, title_chars),
            "venue": F.trim(text_or_empty("venue")),
        }
    )
    rows = rows.withColumns(
        {
            "_arxiv": first_filled("arxiv_id", "_arxiv"),
            "_doi": first_filled("doi", "_doi"),
            "_repo": first_filled(configured, "_repo"),
            "_benchmarked": F.when(F.lower(title).contains("benchmark"), title).otherwise(F.lit("")),
            "metric_value": blank_to_null("_metric"),
            "citation_count": F.coalesce(col("citation_count").cast("bigint"), ids.first_number("_cited")),
        }
    )
    rows = rows.withColumns(
        {
            "arxiv_id": F.when(col("_arxiv") != "", ids.clean_arxiv_id("_arxiv")).otherwise(ids.arxiv_id_in_link(link)),
            "doi": ids.clean_doi(
                F.when(col("_doi") != "", col("_doi")).otherwise(ids.doi_in_text(link, "_summary"))
            ),
            "_repo": ids.trimmed_repository(
                F.when(col("_repo") != "", col("_repo")).otherwise(ids.repository_in_text(title, "_summary", link))
            ),
            "benchmark_name": F.when(col("_benchmark") != "", col("_benchmark")).otherwise(col("_benchmarked")),
        }
    )
    rows = rows.withColumn("repository", ids.shortened_repository("_repo"))
    rows = rows.withColumn("_repo", ids.repository_url("repository"))
    parts = split_url("_repo")
    rows = rows.withColumn("_names", ids.path_parts(parts.path))
    named = F.size("_names") >= 2
    rows = rows.withColumns(
        {
            "repository_host": F.lower(parts.authority),
            "repository_owner": F.when(named, F.get("_names", F.lit(0))).otherwise(F.lit("")),
            "repository_name": F.when(named, ids.drop_suffix(F.get("_names", F.lit(1)), ".git")).otherwise(F.lit("")),
            "paper_id": first_filled("doi", "arxiv_id", link, "normalized_title"),
        }
    )
    return rows.drop("_arxiv", "_doi", "_repo", "_cited", "_benchmark", "_benchmarked", "_metric", "_names")


def with_canonical_key(rows: DataFrame) -> DataFrame:
    """``canonical_key`` and its status ``complete``, ``title_proxy`` or ``missing``."""
    paper = (
        F.when(col("doi") != "", F.concat(F.lit("doi:"), slug("doi")))
        .when(col("arxiv_id") != "", F.concat(F.lit("arxiv:"), slug("arxiv_id")))
        .when(col("normalized_title") != "", F.concat(F.lit("title:"), col("normalized_title")))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("_paper", paper)
    key, model = col("_paper"), col("event_model")
    has_key = key != ""
    is_paper = model.isin("paper_release", "citation_snapshot")
    is_repository, is_benchmark = model == "code_repository", model == "benchmark_result"
    has_repository = (
        (col("repository") != "")
        & (col("repository_host") != "")
        & (col("repository_owner") != "")
        & (col("repository_name") != "")
    )
    has_result = has_key & (col("benchmark_name") != "") & (col("metric_name") != "") & col("metric_value").isNotNull()
    repository_key = F.concat(
        F.concat_ws(
            ":", F.lit("repository"), slug("repository_host"), slug("repository_owner"), slug("repository_name")
        ),
        F.when(has_key, F.concat(F.lit(":paper:"), slug(key))).otherwise(F.lit("")),
    )
    benchmark_key = F.concat_ws(
        ":", F.lit("benchmark"), slug(key), slug("benchmark_name"), slug("metric_name"), slug("metric_value")
    )
    complete, proxy = F.lit("complete"), F.lit("title_proxy")
    status = (
        F.when(is_repository & has_repository, complete)
        .when(is_benchmark & has_result, complete)
        .when(~has_key, F.lit("missing"))
        .when(is_paper, F.when(key.rlike("^(doi|arxiv):"), complete).otherwise(proxy))
        .when(is_repository | is_benchmark, proxy)
        .otherwise(complete)
    )
    canonical = (
        F.when(is_repository & has_repository, repository_key)
        .when(is_benchmark & has_result, benchmark_key)
        .when(has_key, F.concat(F.lit("paper:"), key))
        .otherwise(F.lit(""))
    )
    return rows.withColumn("canonical_key", canonical).withColumn("canonical_key_status", status).drop("_paper")


def event_key() -> Column:
    """``model:source:digest:date`` with the digest of the paper id, else the link, else source and title."""
    basis = F.coalesce(
        blank_to_null("paper_id"),
        blank_to_null("url"),
        F.concat(col("source"), F.lit(":"), text_or_empty("title")),
    )
    day = F.coalesce(F.date_format("event_at", "yyyy-MM-dd"), F.lit("undated"))
    return F.concat_ws(":", col("event_model"), slug("source"), short_digest(basis), day)


def _has_field(name: str) -> Column:
    """Whether the article shows the required field; the first rule that knows the name decides."""
    n = name.lower()
    title, url = text_or_empty("title"), col("url")
    entities = F.lower(F.array_join(F.flatten(F.map_values("matched_entities")), " "))
    entities = F.coalesce(entities, F.lit(""))
    text = F.lower(F.concat_ws(" ", title, col("_summary"), url))
    if n in ("source", "source_name"):
        return col("source") != ""
    if n in ("source_url", "evidence_url"):
        return col("source_url") != ""
    if n in ("title", "normalized_title"):
        return title != ""
    if n in ("paper_id", "project_id", "facility_id", "attraction_id", "service_id"):
        return (url != "") | (title != "")
    if n in ("repository", "host", "owner", "repo"):
        return col("repository") != ""
    if n in ("arxiv_id", "doi", "benchmark_name", "metric_name"):
        return col(n) != ""
    if n in ("citation_count", "metric_value"):
        return col(n).isNotNull()
    if n in ("wait_minutes", "price", "transaction_price"):
        return text.rlike(r"\p{Nd}")
    if n == "currency":
        return F.greatest(*[text.contains(t) for t in CURRENCY_TOKENS])
    if n in ("region_code", "complex_name", "property_type"):
        return (entities != "") | (title != "")
    if n.endswith("_date") or n.endswith("_time") or n == "observed_at":
        return article_time().isNotNull()
    return text.contains(n) | entities.contains(n)


def _is_filled(rows: DataFrame, name: str) -> Column:
    """Whether a column of the event holds something."""
    if name not in EVENT_COLUMNS or name == "required_field_gaps":
        return F.lit(False)
    kind = rows.schema[name].dataType.typeName()
    if kind == "string":
        return F.coalesce(F.trim(col(name)) != "", F.lit(False))
    if kind in ("map", "array"):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    return col(name).isNotNull()


def with_required_fields(rows: DataFrame, settings: QualitySettings) -> DataFrame:
    """``required_field_proxy`` (field -> shown) and ``required_field_gaps`` per event model."""
    proxies = F.expr("cast(map() as map<string,boolean>)")
    by_model = {m: list(dict.fromkeys(f)) for m, f in settings.required_fields.items() if f}
    chosen = None
    for model, fields in by_model.items():
        shown = F.create_map(*[c for f in fields for c in (F.lit(f), _has_field(f))])
        test = col("event_model") == model
        chosen = F.when(test, shown) if chosen is None else chosen.when(test, shown)
    rows = rows.withColumn("required_field_proxy", proxies if chosen is None else chosen.otherwise(proxies))
    empty = _strings([])
    gaps = None
    for model, fields in settings.required_fields.items():
        tests = [
            F.when(
                ~F.coalesce(F.try_element_at(col("required_field_proxy"), F.lit(f)), F.lit(False))
                & ~_any([_is_filled(rows, c) for c in FIELD_COLUMNS.get(f.lower(), (f.lower(),))]),
                F.lit(f),
            )
            for f in fields
        ]
        if tests:
            found = F.filter(F.array(*tests), lambda g: g.isNotNull())
            test = col("event_model") == model
            gaps = F.when(test, found) if gaps is None else gaps.when(test, found)
    return rows.withColumn("required_field_gaps", empty if gaps is None else gaps.otherwise(empty))


def _any(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


EVENT_COLUMNS = [
    "source",
    "source_type",
    "trust_tier",
    "producer_role",
    "event_model",
    "title",
    "url",
    "source_url",
    "event_at",
    "event_key",
    "paper_id",
    "arxiv_id",
    "doi",
    "normalized_title",
    "repository",
    "repository_host",
    "repository_owner",
    "repository_name",
    "citation_count",
    "benchmark_name",
    "metric_name",
    "metric_value",
    "dataset",
    "venue",
    "matched_entities",
    "required_field_proxy",
    "canonical_key",
    "canonical_key_status",
    "required_field_gaps",
]


def build_events(
    articles: DataFrame, sources: DataFrame, settings: QualitySettings, *, title_chars: int | None = 96
) -> DataFrame:
    """One event per article of a known source whose event model is tracked."""
    dimension = source_models(sources, settings.tracked_models).where("tracked")
    dimension = dimension.select(
        col("name").alias("source"),
        col("type").alias("source_type"),
        "trust_tier",
        "producer_role",
        "event_model",
        col("url").alias("_source_home"),
        first_filled(*[_setting(s) for s in REPOSITORY_SETTINGS]).alias("_repository"),
    )
    rows = with_optional_columns(articles).join(dimension, "source")
    rows = with_identifiers(rows, configured_repository=col("_repository"), title_chars=title_chars)
    rows = rows.withColumns({"title": text_or_empty("title"), "url": text_or_empty("link"), "event_at": event_time()})
    rows = rows.withColumn("source_url", F.coalesce(blank_to_null("url"), col("_source_home"), F.lit("")))
    rows = rows.withColumn("event_key", event_key())
    rows = with_canonical_key(rows)
    rows = with_required_fields(rows, settings)
    return rows.select(*EVENT_COLUMNS)


def missing_models(events_or_rollup: DataFrame, settings: QualitySettings) -> DataFrame:
    """Tracked models without any event, in configuration order."""
    spark = events_or_rollup.sparkSession
    models = spark.createDataFrame(list(enumerate(settings.tracked_models)), "position int, event_model string")
    seen = events_or_rollup.select("event_model").distinct()
    return models.join(seen, "event_model", "left_anti")
