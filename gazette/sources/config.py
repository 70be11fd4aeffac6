"""Category configuration (YAML) as dimension tables and plain settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import KEYWORD, SOURCE

# Event models tracked when the configuration names none.
DEFAULT_MODELS = ["paper_release", "citation_snapshot", "code_repository", "benchmark_result"]


class Keyword(NamedTuple):
    """One dictionary entry; ``pos`` keeps the order and duplicates of the configuration."""

    entity: str
    pos: int
    keyword: str


@dataclass(frozen=True)
class QualitySettings:
    """Tracked models, required fields, freshness limits and the list of sources still to come."""

    tracked_models: list[str] = field(default_factory=lambda: list(DEFAULT_MODELS))
    required_fields: dict[str, list[str]] = field(default_factory=dict)
    freshness: dict[str, float] = field(default_factory=dict)
    backlog: list[dict[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Category:
    name: str
    display_name: str
    sources: list[dict[str, Any]]
    keywords: list[Keyword]
    quality: QualitySettings


def _mapping(value: object) -> dict[str, Any]:
    return {str(k): v for k, v in value.items()} if isinstance(value, Mapping) else {}


def _number(value: object) -> float | None:
    if value is None or isinstance(value, bool):
        return None
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def keywords_of(entities: list[Mapping[str, Any]]) -> list[Keyword]:
    """Lower-cased keywords of the entities in order; empty ones are left out."""
    rows = []
    for entity in entities:
        for keyword in entity.get("keywords") or []:
            if str(keyword):
                rows.append(Keyword(str(entity["name"]), len(rows), str(keyword).lower()))
    return rows


def quality_settings(raw: Mapping[str, Any]) -> QualitySettings:
    quality = _mapping(raw.get("data_quality"))
    models = _mapping(quality.get("event_models"))
    listed = _mapping(quality.get("quality_outputs")).get("tracked_event_models")
    tracked = [str(m).strip() for m in listed if str(m).strip()] if isinstance(listed, list) else []
    fields = {
        name: [str(f) for f in _mapping(body).get("required_fields") or [] if str(f).strip()]
        for name, body in models.items()
    }
    limits = {k: _number(v) for k, v in _mapping(quality.get("freshness_sla")).items()}
    backlog = _mapping(raw.get("source_backlog")).get("operational_candidates")
    return QualitySettings(
        tracked_models=tracked or list(models) or list(DEFAULT_MODELS),
        required_fields=fields,
        freshness={k: v for k, v in limits.items() if v is not None},
        backlog=[
            {k: str(v or "") for k, v in _mapping(item).items()}
            for item in (backlog if isinstance(backlog, list) else [])
            if isinstance(item, Mapping)
        ],
    )


def category_from(raw: Mapping[str, Any]) -> Category:
    name = str(raw.get("category_name") or "")
    return Category(
        name=name,
        display_name=str(raw.get("display_name") or name),
        sources=[_mapping(s) for s in raw.get("sources") or []],
        keywords=keywords_of([_mapping(e) for e in raw.get("entities") or []]),
        quality=quality_settings(raw),
    )


def load_category(path: str) -> Category:
    """Read one category file; it is configuration, a few hundred rows at most."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return category_from(yaml.safe_load(handle) or {})


def sources_table(spark: SparkSession, sources: list[Mapping[str, Any]]) -> DataFrame:
    """Source dimension in configuration order; configuration values become text.

    From Arrow the size of the table is known, so that a short list of sources is broadcast and no payload or article is
    moved to meet its source.
    """
    rows = []
    for position, source in enumerate(sources):
        text = {
            k: str(source.get(k) or "")
            for k in (
                "name type url language country trust_tier collection_tier content_type producer_role notes"
            ).split()
        }
        rows.append(
            (
                position,
                text["name"],
                text["type"],
                text["url"],
                bool(source.get("enabled", True)),
                text["language"],
                text["country"],
                text["trust_tier"],
                text["collection_tier"],
                text["content_type"],
                text["producer_role"],
                [str(p) for p in source.get("info_purpose") or []],
                text["notes"],
                {k: str(v) for k, v in _mapping(source.get("config")).items()},
            )
        )
    text = pa.string()
    other = {"position": pa.int32(), "enabled": pa.bool_(), "info_purpose": pa.list_(text), "config": pa.map_(text, text)}
    names = [part.split()[0] for part in SOURCE.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    listed = {n: pa.array([list(v.items()) for v in c] if n == "config" else c, other.get(n, text)) for n, c in zip(names, columns)}
    return spark.createDataFrame(pa.table(listed), SOURCE)


def keywords_table(spark: SparkSession, category: Category) -> DataFrame:
    return spark.createDataFrame([(k.entity, k.entity, k.pos, k.keyword) for k in category.keywords], KEYWORD)


def backlog_table(spark: SparkSession, settings: QualitySettings) -> DataFrame:
    rows = [
        (i, b.get("name", ""), b.get("signal_type", ""), b.get("activation_gate", ""))
        for i, b in enumerate(settings.backlog)
    ]
    return spark.createDataFrame(rows, "position int, name string, signal_type string, activation_gate string")
