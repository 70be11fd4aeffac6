"""Queries on feed normalisation: payloads of twenty documents each, written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import col
from ..sources import feeds
from .base import ARTICLES, articles_view, register, stamp, stamp_sql

SIZE = 20


def _grouped(spark, folder, kind, item, wrap, *, keep=None):
    """One payload per twenty documents in the order of their numbers."""
    rows = articles_view(spark, folder)
    if keep is not None:
        rows = rows.where(keep)
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda s: s["item"]
    )
    payloads = rows.groupBy(F.floor(col("doc_id") / SIZE).alias("payload_id")).agg(items.alias("items"))
    return payloads.select(
        F.concat(F.lit("feed"), col("payload_id").cast("string")).alias("source"),
        F.lit(kind).alias("type"),
        F.lit("research").alias("category"),
        wrap(col("items")).alias("payload"),
        F.expr("cast(map() as map<string,string>)").alias("config"),
    )


def _shown(rows):
    return rows.select("source", "position", "title", "link", "summary", stamp("published"))


def _mail_date():
    return F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def rss_payloads(spark, folder):
    n = col("doc_id")
    item = F.struct(
        F.concat(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit(" &copy; &#233;")).alias("title"),
        "link",
        F.when(n % 5 > 1, col("summary")).alias("description"),
        _mail_date().alias("pubDate"),
        F.when(n % 5 == 0, col("summary")).alias("encoded"),
    )

    def wrap(items):
        text = F.to_xml(F.struct(F.struct(items.alias("item")).alias("channel")), {"rowTag": "rss"})
        space = '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/">'
        return F.regexp_replace(F.replace(text, F.lit("<rss>"), F.lit(space)), "(</?)encoded>", "$1content:encoded>")

    return _grouped(spark, folder, "rss", item, wrap)


_STRIPPED = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
# The payload carries whole seconds.
_SECONDS = "strftime(date_trunc('second', published), '%Y-%m-%d %H:%M:%S.000000')"
_PLACE = "'feed' || (doc_id // 20) AS source, doc_id % 20 AS position"


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, {_STRIPPED.format("title || ' © é'")} AS title, link,
  CASE WHEN doc_id % 5 = 1 THEN {_STRIPPED.format("title || ' © é'")} ELSE {_STRIPPED.format('summary')} END AS summary,
  {_SECONDS} AS published FROM articles_v""")
def feed_rss(spark, folder):
    return _shown(feeds.rss_rows(rss_payloads(spark, folder)))


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, link FROM articles_v WHERE doc_id % 20 < 15""")
def feed_rss_limited(spark, folder):
    """The feature of a limit per payload: the first fifteen entries of each."""
    return feeds.rss_rows(rss_payloads(spark, folder), limit=15).select("source", "position", "link")


def atom_payloads(spark, folder, kind="arxiv"):
    number = F.lpad(col("doc_id").cast("string"), 5, "0")
    address = F.concat(F.lit("http://arxiv.org/abs/2401."), number, F.lit("v1"))
    item = F.struct(
        address.alias("id"),
        F.concat(F.lit(" A: "), "title").alias("title"),
        F.when(col("doc_id") % 4 > 0, col("summary")).alias("summary"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"),
        F.array(
            F.struct(F.concat(address, F.lit("#pdf")).alias("_href"), F.lit("related").alias("_rel")),
            F.struct(F.concat(address, F.lit("#page")).alias("_href"), F.lit("alternate").alias("_rel")),
        ).alias("link"),
    )
    return _grouped(
        spark, folder, kind, item, lambda items: F.to_xml(F.struct(items.alias("entry")), {"rowTag": "feed"})
    )


@register(f"""WITH {ARTICLES}, a AS (SELECT *, 'http://arxiv.org/abs/2401.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1' AS address FROM articles_v)
SELECT {_PLACE}, {_STRIPPED.format("'A: ' || title")} AS title, address || '#page' AS link,
  CASE WHEN doc_id % 4 > 0 THEN {_STRIPPED.format('summary')} ELSE '' END AS summary, {_SECONDS} AS published,
  array_to_string(authors, '|') AS authors, '2401.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1' AS arxiv_id,
  'https://arxiv.org/pdf/2401.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1.pdf' AS pdf_url FROM a""")
def feed_atom(spark, folder):
    rows = feeds.atom_paper_rows(atom_payloads(spark, folder))
    return rows.select(
        "source", "position", "title", "link", "summary", stamp("published"), F.array_join("authors", "|").alias("authors"),
        "arxiv_id", "pdf_url",
    )


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, {_STRIPPED.format("title || ' © é'")} AS title, link,
  CASE WHEN doc_id % 5 > 1 THEN {_STRIPPED.format('summary')} ELSE '' END AS summary,
  {_SECONDS} AS published FROM articles_v""")
def feed_medical_index(spark, folder):
    return _shown(feeds.feed_paper_rows(rss_payloads(spark, folder)))


def _json_payloads(spark, folder, kind, item, name):
    return _grouped(spark, folder, kind, item, lambda items: F.to_json(F.struct(items.alias(name))))


def scholar_payloads(spark, folder):
    n = col("doc_id")
    links = F.when(n % 3 == 0, F.array(F.struct(F.lit("").alias("url")), F.struct(col("link").alias("url"))))
    item = F.struct(
        "title",
        F.coalesce(links, F.array().cast("array<struct<url:string>>")).alias("externalLinks"),
        F.struct(F.when(n % 3 == 1, F.concat(F.lit("10.1/"), n.cast("string"))).alias("DOI")).alias("externalIds"),
        col("summary").alias("abstract"),
        F.when(n % 2 == 0, 1990 + n % 30).alias("year"),
    )
    return _json_payloads(spark, folder, "semantic_scholar", item, "data")


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, title, CASE WHEN doc_id % 3 = 0 THEN link ELSE 'https://doi.org/10.1/' || doc_id END AS link, summary,
  CASE WHEN doc_id % 2 = 0 THEN (1990 + doc_id % 30) || '-01-01 00:00:00.000000' END AS published
FROM articles_v WHERE doc_id % 3 < 2 AND title <> ''""")
def feed_scholar(spark, folder):
    return _shown(feeds.scholar_rows(scholar_payloads(spark, folder)))


def preprint_payloads(spark, folder):
    n = col("doc_id")
    paragraphs = F.transform(F.split("summary", "\n"), lambda p: F.struct(p.alias("data")))
    item = F.struct(
        "title",
        F.struct(F.when(n % 3 == 0, col("link")).otherwise(F.lit("")).alias("htmlUrl")).alias("links"),
        F.when(n % 3 == 1, F.concat(F.lit("10.1/"), n.cast("string"))).alias("doi"),
        F.when(F.lit(True), paragraphs).alias("abstract"),
        F.date_format("published", "yyyy-MM-dd").alias("published"),
    )
    return _json_payloads(spark, folder, "biorxiv", item, "entries")


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, title, CASE WHEN doc_id % 3 = 0 THEN link ELSE 'https://doi.org/10.1/' || doc_id END AS link,
  replace(summary, chr(10), ' ') AS summary, strftime(published, '%Y-%m-%d 00:00:00.000000') AS published
FROM articles_v WHERE doc_id % 3 < 2 AND title <> ''""")
def feed_preprints(spark, folder):
    return _shown(feeds.preprint_rows(preprint_payloads(spark, folder)))


def works_payloads(spark, folder):
    n = col("doc_id")
    item = F.struct(
        F.when(n % 4 > 0, F.concat(F.lit("W"), n.cast("string"))).alias("id"),
        F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), n.cast("string")))
        .when(n % 3 == 1, F.concat(F.lit("10.1/"), n.cast("string")))
        .alias("doi"),
        F.when(n % 2 == 0, col("title")).alias("display_title"),
        F.when(n % 2 == 1, col("title")).alias("title"),
        F.when(n % 7 > 0, col("summary")).alias("abstract"),
        F.when(n % 5 > 0, col("n_chars")).alias("cited_by_count"),
        F.date_format("published", "yyyy-MM-dd").alias("publication_date"),
        (1990 + n % 30).alias("publication_year"),
    )
    return _json_payloads(spark, folder, "openalex", item, "results")


@register(f"""WITH {ARTICLES}, w AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN 'W' || doc_id END AS work,
  CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1/' || doc_id WHEN 1 THEN '10.1/' || doc_id END AS doi FROM articles_v)
SELECT {_PLACE}, title, CASE doc_id % 3 WHEN 0 THEN doi WHEN 1 THEN 'https://doi.org/' || doi ELSE 'https://openalex.org/' || work END AS link,
  concat_ws('. ', CASE WHEN doc_id % 7 > 0 THEN nullif(summary, '') END, 'DOI: ' || doi, CASE WHEN doc_id % 5 > 0 THEN 'Citation count: ' || n_chars END,
    CASE WHEN published IS NOT NULL THEN 'Publication date: ' || strftime(published, '%Y-%m-%d') ELSE 'Publication year: ' || (1990 + doc_id % 30) END,
    'OpenAlex ID: ' || work) AS summary,
  CASE WHEN published IS NOT NULL THEN strftime(published, '%Y-%m-%d 00:00:00.000000') ELSE (1990 + doc_id % 30) || '-01-01 00:00:00.000000' END AS published
FROM w WHERE title <> '' AND (doi IS NOT NULL OR work IS NOT NULL)""")
def feed_works(spark, folder):
    return _shown(feeds.works_rows(works_payloads(spark, folder)))


def registry_payloads(spark, folder):
    n = col("doc_id")
    year, month, day = (1990 + n % 30).cast("int"), (n % 14).cast("int"), (n % 28 + 1).cast("int")
    parts = (
        F.when(n % 4 == 0, F.array(year)).when(n % 4 == 1, F.array(year, month)).when(n % 4 == 2, F.array(year, month, day))
    )
    item = F.struct(
        F.array("title").alias("title"),
        F.when(n % 5 > 0, F.concat(F.lit("10.1/"), n.cast("string"))).alias("DOI"),
        col("summary").alias("abstract"),
        F.when(parts.isNotNull(), F.struct(F.array(parts).alias("date-parts"))).alias("published"),
    )
    return _json_payloads(spark, folder, "crossref", item, "items")


@register(f"""WITH {ARTICLES} SELECT {_PLACE}, title, 'https://doi.org/10.1/' || doc_id AS link, summary,
  CASE WHEN doc_id % 4 = 0 THEN (1990 + doc_id % 30) || '-01-01 00:00:00.000000'
       WHEN doc_id % 4 = 3 OR doc_id % 14 NOT BETWEEN 1 AND 12 THEN NULL
       WHEN doc_id % 4 = 1 THEN (1990 + doc_id % 30) || '-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-01 00:00:00.000000'
       ELSE (1990 + doc_id % 30) || '-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00.000000' END AS published
FROM articles_v WHERE doc_id % 5 > 0 AND title <> ''""")
def feed_registry(spark, folder):
    return _shown(feeds.registry_rows(registry_payloads(spark, folder)))


def mixed_payloads(spark, folder):
    """Payloads of all types by number, with broken, empty and unknown ones between them."""
    made = [
        rss_payloads(spark, folder),
        atom_payloads(spark, folder),
        scholar_payloads(spark, folder),
        works_payloads(spark, folder),
    ]
    rows = None
    for i, part in enumerate(made):
        mine = part.where((F.substring("source", 5, 9).cast("int") % 6) == i)
        rows = mine if rows is None else rows.unionByName(mine)
    number = F.substring("source", 5, 9).cast("int") % 6
    bad = made[0].where(number == 4).withColumn("payload", F.lit("<rss><channel><item>"))
    unknown = made[0].where(number == 5).withColumn("type", F.lit("gopher"))
    return rows.unionByName(bad).unionByName(unknown)


@register(f"""WITH {ARTICLES}, p AS (SELECT *, doc_id // 20 AS f, (doc_id // 20) % 6 AS k FROM articles_v),
good AS (SELECT 'row' AS kind, 'feed' || f AS source, count(*) AS n FROM p WHERE
  (k < 2 OR (k = 2 AND doc_id % 3 < 2 AND title <> '') OR (k = 3 AND title <> '' AND (doc_id % 3 < 2 OR doc_id % 4 > 0))) GROUP BY f)
SELECT kind, source, n, '' AS message FROM good
UNION ALL SELECT DISTINCT 'error', 'feed' || f, 1, 'feed' || f || CASE WHEN k = 4 THEN ': Failed to parse payload' ELSE ': Unsupported source type ''gopher''' END FROM p WHERE k >= 4""")
def feed_mixed(spark, folder):
    rows, errors = feeds.normalise_feeds(
        mixed_payloads(spark, folder), types=["rss", "arxiv", "semantic_scholar", "openalex"]
    )
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    good = counts.select(F.lit("row").alias("kind"), "source", "n", F.lit("").alias("message"))
    bad = errors.select(F.lit("error").alias("kind"), "source", F.lit(1).cast("bigint").alias("n"), "message")
    return good.unionByName(bad)
