"""Queries on the data-quality checks and read-only SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import quality_checks as qc
from ..operators.read_only_sql import read_only_sql
from .base import (
    ARTICLES, AS_OF, AS_OF_SQL, COPIES, DIRTY, articles_view, copies_view, dirty_view, register, stamp, stamp_sql, table,
)

_CONDITIONS = {
    "title": "title IS NULL OR title = ''",
    "link": "link IS NULL OR link = ''",
    "summary": "trim(summary) = ''",
    "published": "published IS NULL",
}
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS field, count(*) FILTER ({c}) AS missing, count(*) AS total, "
    f"count(*) FILTER ({c}) / count(*) * 100 AS percent FROM dirty_v"
    for n, c in _CONDITIONS.items()
)


@register(f"WITH {DIRTY} {_MISSING_SQL}")
def missing_fields(spark, folder):
    return qc.missing_fields(dirty_view(spark, folder), _CONDITIONS)


@register(f"WITH {COPIES} SELECT link AS url, count(*) AS n FROM copies_v GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, url LIMIT 10")
def duplicate_urls(spark, folder):
    return qc.duplicate_urls(copies_view(spark, folder), url_column="link")


@register(f"WITH {COPIES} SELECT count(*) AS duplicate_links FROM (SELECT link FROM copies_v GROUP BY 1 HAVING count(*) > 1)")
def duplicate_link_count(spark, folder):
    return qc.duplicate_link_count(copies_view(spark, folder))


@register("SELECT 'text' AS \"column\", avg(length(text)) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length "
          "FROM documents UNION ALL SELECT 'source', avg(length(source)), min(length(source)), max(length(source)) FROM documents")
def text_lengths(spark, folder):
    return qc.text_lengths(table(spark, folder, "documents"), ["text", "source"])


@register("SELECT language, count(*) AS n, coalesce(language NOT IN ('en', 'fr'), false) AS invalid FROM "
          "(SELECT CASE WHEN doc_id % 10 <> 0 THEN lang END AS language FROM documents) GROUP BY language")
def language_distribution(spark, folder):
    rows = table(spark, folder, "documents").select(F.when(col("doc_id") % 10 != 0, col("lang")).alias("language"))
    return qc.language_values(rows, allowed={"en", "fr"})


@register(f"SELECT count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS future, {stamp_sql('min(o_orderdate)')} AS oldest, "
          f"{stamp_sql('max(o_orderdate)')} AS newest FROM orders")
def date_check(spark, folder):
    rows = qc.date_check(table(spark, folder, "orders"), date_column="o_orderdate", as_of=dt.datetime(2001, 1, 1))
    return rows.withColumns({"oldest": stamp("oldest"), "newest": stamp("newest")})


@register(f"WITH {ARTICLES} SELECT {stamp_sql('min(coalesce(published, collected_at))')} AS oldest, "
          f"{stamp_sql('max(coalesce(published, collected_at))')} AS newest, "
          "count(*) FILTER (published > TIMESTAMP '2024-01-03 00:00:00') AS future FROM articles_v")
def date_check_fallback(spark, folder):
    rows = qc.date_check_fallback(articles_view(spark, folder), as_of=dt.datetime(2024, 1, 3))
    return rows.withColumns({"oldest": stamp("oldest"), "newest": stamp("newest")})


_ALL_SQL = (
    "SELECT 'total' AS \"check\", '' AS item, 'rows' AS metric, count(*)::VARCHAR AS value FROM copies_v "
    + "".join(
        f"UNION ALL SELECT 'missing', '{n}', 'rows', (count(*) FILTER ({c}))::VARCHAR FROM copies_v " for n, c in _CONDITIONS.items()
    )
    + "".join(
        f"UNION ALL SELECT 'length', '{c}', 'avg', printf('%.4f', avg(length({c}))) FROM copies_v "
        f"UNION ALL SELECT 'length', '{c}', 'min', min(length({c}))::VARCHAR FROM copies_v "
        f"UNION ALL SELECT 'length', '{c}', 'max', max(length({c}))::VARCHAR FROM copies_v "
        for c in ("title", "summary")
    )
    + f"UNION ALL SELECT 'date', 'collected_at', 'future', (count(*) FILTER (collected_at > {AS_OF_SQL}))::VARCHAR FROM copies_v "
    "UNION ALL SELECT 'date', 'collected_at', 'oldest', strftime(min(collected_at), '%Y-%m-%d %H:%M:%S') FROM copies_v "
    "UNION ALL SELECT 'date', 'collected_at', 'newest', strftime(max(collected_at), '%Y-%m-%d %H:%M:%S') FROM copies_v "
    "UNION ALL SELECT 'duplicate_url', link, 'rows', n::VARCHAR FROM "
    "(SELECT link, count(*) AS n FROM copies_v GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, link LIMIT 10) "
    "UNION ALL SELECT 'language', category, CASE WHEN category NOT IN ('en', 'fr') THEN 'invalid' ELSE 'rows' END, count(*)::VARCHAR "
    "FROM copies_v GROUP BY category"
)


@register(f"WITH {COPIES} {_ALL_SQL}")
def all_checks(spark, folder):
    return qc.all_checks(
        copies_view(spark, folder),
        conditions=_CONDITIONS,
        text_columns=["title", "summary"],
        language_column="category",
        allowed_languages={"en", "fr"},
        url_column="link",
        date_column="collected_at",
        as_of=AS_OF,
    )


@register("WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1) "
          "SELECT c_mktsegment, sum(n)::BIGINT AS orders, round(sum(total), 2) AS total FROM spent JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def sql_read_only(spark, folder):
    """Over views with names of its own, which it drops again."""
    own = {name: f"sql_read_only_{name}" for name in ("orders", "customer")}
    for name, view in own.items():
        table(spark, folder, name).createOrReplaceTempView(view)
    rows = read_only_sql(
        spark,
        f"WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM {own['orders']} GROUP BY 1) "
        "SELECT c_mktsegment, sum(n) AS orders, round(sum(total), 2) AS total FROM spent "
        f"JOIN {own['customer']} ON c_custkey = o_custkey GROUP BY 1;",
    )
    for view in own.values():
        spark.catalog.dropTempView(view)
    return rows
