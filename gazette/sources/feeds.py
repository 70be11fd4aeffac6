"""Feed payloads as rows: RSS, Atom, and the JSON answers of paper services.

A payload table has ``source``, ``type``, ``category``, ``payload`` and optionally ``config`` of the source.
Each type has one function from payloads to rows; :func:`normalise_feeds` sends every payload to its function
and returns the rows together with the payloads that cannot be read, so a bad one never stops the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import feed_timestamp, iso_timestamp
from ..functions.text import blank_to_null, col, strip_chars, text_or_empty, unescape_html

_ENTRY = (
    "struct<title:string,link:array<struct<_VALUE:string,_href:string,_rel:string>>,id:string,description:string,"
    "summary:string,encoded:string,content:string,pubDate:string,published:string,updated:string,date:string,"
    "creator:string,author:array<struct<_VALUE:string,name:string>>>"
)
_FEED = f"struct<channel:struct<item:array<{_ENTRY}>>,item:array<{_ENTRY}>,entry:array<{_ENTRY}>,_corrupt_record:string>"

# Columns of every normalised row.
ROW = [
    "source",
    "category",
    "position",
    "title",
    "link",
    "summary",
    "published",
    "authors",
    "arxiv_id",
    "pdf_url",
]


def _entries(payloads: DataFrame, schema: str, items: Callable[[Column], Column], read: Callable, limit: int | None) -> DataFrame:
    """The entries of every payload in their order; with ``limit``, only its first ones."""
    parsed = payloads.withColumn("_doc", read(col("payload"), schema))
    found = items(col("_doc"))
    listed = parsed.withColumn("_items", found if limit is None else F.slice(found, 1, limit))
    return listed.select("source", "category", "config", F.posexplode("_items").alias("position", "e"))


def _xml(c: Column, schema: str) -> Column:
    return F.from_xml(c, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def _json(c: Column, schema: str) -> Column:
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def _feed_entries(payloads: DataFrame, limit: int | None) -> DataFrame:
    return _entries(payloads, _FEED, lambda d: F.coalesce(d["channel"]["item"], d["entry"], d["item"]), _xml, limit)


def _trimmed(c: Column) -> Column:
    return strip_chars(F.coalesce(c, F.lit("")), " \t\r\n\x0b\x0c")


def _unescaped(c: Column) -> Column:
    return unescape_html(_trimmed(c))


def entry_authors(authors: Column, single: Column) -> Column:
    """Trimmed non-blank names, else the single author, else an empty array."""
    names = F.filter(F.transform(authors, lambda a: F.trim(a)), lambda n: n != "")
    names = F.coalesce(names, F.array().cast("array<string>"))
    one = F.trim(single)
    return F.when(F.size(names) > 0, names).when(F.coalesce(one, F.lit("")) != "", F.array(one)).otherwise(names)


def _entry_link() -> Column:
    text = F.get(F.filter(F.transform("e.link", lambda x: x["_VALUE"]), lambda v: F.trim(v) != ""), F.lit(0))
    page = F.filter(
        col("e.link"), lambda x: x["_href"].isNotNull() & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    )
    return F.trim(F.coalesce(text, F.get(page, F.lit(0))["_href"], F.lit("")))


def _entry_time() -> Column:
    return feed_timestamp("e.pubDate", "e.published", "e.updated", "e.date")


def _finish(rows: DataFrame) -> DataFrame:
    kept = rows.where((col("title") != "") & (col("link") != ""))
    empty = {
        "authors": F.array().cast("array<string>"),
        "arxiv_id": F.lit(None).cast("string"),
        "pdf_url": F.lit(None).cast("string"),
    }
    kept = kept.withColumns({n: c for n, c in empty.items() if n not in rows.columns})
    return kept.select(*ROW)


def rss_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """RSS 2.0, RSS 1.0 and Atom entries; a missing summary becomes the content, else the title."""
    rows = _feed_entries(payloads, limit)
    summary = F.coalesce(*[blank_to_null(f"e.{c}") for c in ("summary", "description", "encoded", "content")])
    rows = rows.withColumns(
        {"title": _unescaped(col("e.title")), "link": _entry_link(), "published": _entry_time()}
    )
    rows = rows.withColumn("summary", _unescaped(F.coalesce(summary, col("title"))))
    return _finish(rows.where(col("title") != "(no title)"))


def atom_paper_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Atom entries of a preprint server, with authors, id and PDF address."""
    rows = _feed_entries(payloads, limit)
    raw_id = _trimmed(col("e.id"))
    rows = rows.withColumns(
        {
            "title": _unescaped(col("e.title")),
            "link": F.coalesce(blank_to_null(_entry_link()), raw_id),
            "published": _entry_time(),
            "summary": F.coalesce(
                blank_to_null(_unescaped(col("e.summary"))), _unescaped(F.coalesce("e.content", "e.encoded"))
            ),
            "authors": entry_authors(
                F.transform("e.author", lambda a: F.coalesce(a["name"], a["_VALUE"])), col("e.creator")
            ),
        }
    )
    address = F.coalesce(blank_to_null(raw_id), col("link"))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.trim(F.element_at(F.split(F.coalesce(blank_to_null(path), address), "/"), -1))
    rows = rows.withColumn("arxiv_id", blank_to_null(last))
    pdf = F.concat(F.lit("https://arxiv.org/pdf/"), col("arxiv_id"), F.lit(".pdf"))
    return _finish(rows.withColumn("pdf_url", pdf))


def feed_paper_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Feed of a medical index: title, link, summary or description, date."""
    rows = _feed_entries(payloads, limit)
    summary = F.coalesce(blank_to_null("e.summary"), col("e.description"))
    return _finish(
        rows.withColumns(
            {
                "title": _unescaped(col("e.title")),
                "link": _entry_link(),
                "summary": _unescaped(summary),
                "published": _entry_time(),
            }
        )
    )


def _doi_link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), blank_to_null(doi))


def _text_of(raw: Column, key: str, *, joined: bool) -> Column:
    """A text that is either a JSON string or a list of objects with the text under ``key``."""
    listed = F.transform(F.from_json(raw, f"array<struct<{key}:string>>"), lambda p: F.coalesce(p[key], F.lit("")))
    from_list = F.array_join(listed, " ") if joined else F.get(listed, F.lit(0))
    return F.coalesce(F.when(raw.startswith("["), from_list).otherwise(raw), F.lit(""))


def _first_of_year(year: Column) -> Column:
    return F.try_make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))


def scholar_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``data[]`` with the first external link, else the DOI; published on the first of the year."""
    schema = (
        "struct<data:array<struct<title:string,externalLinks:array<struct<url:string>>,externalIds:struct<DOI:string>,"
        "abstract:string,year:int>>>"
    )
    rows = _entries(payloads, schema, lambda d: d["data"], _json, limit)
    links = F.filter(F.transform("e.externalLinks", lambda x: x["url"]), lambda u: u != "")
    return _finish(
        rows.withColumns(
            {
                "title": text_or_empty("e.title"),
                "link": F.coalesce(F.get(links, F.lit(0)), _doi_link(col("e.externalIds.DOI")), F.lit("")),
                "summary": _text_of(col("e.abstract"), "text", joined=False),
                "published": _first_of_year(col("e.year")),
            }
        )
    )


def preprint_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``entries[]`` with an HTML link, else the DOI; the abstract may come in paragraphs."""
    schema = (
        "struct<entries:array<struct<title:string,links:struct<htmlUrl:string>,doi:string,abstract:string,published:string>>>"
    )
    rows = _entries(payloads, schema, lambda d: d["entries"], _json, limit)
    return _finish(
        rows.withColumns(
            {
                "title": text_or_empty("e.title"),
                "link": F.coalesce(blank_to_null("e.links.htmlUrl"), _doi_link(col("e.doi")), F.lit("")),
                "summary": _text_of(col("e.abstract"), "data", joined=True),
                "published": iso_timestamp("e.published"),
            }
        )
    )


def works_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``results[]`` of an open catalogue; the summary is put together from labelled parts."""
    schema = (
        "struct<results:array<struct<id:string,doi:string,ids:struct<doi:string>,display_title:string,"
        "display_name:string,title:string,abstract:string,cited_by_count:string,publication_date:string,"
        "publication_year:int,year:int>>>"
    )
    rows = _entries(payloads, schema, lambda d: d["results"], _json, limit)
    doi = F.trim(F.coalesce(blank_to_null("e.doi"), col("e.ids.doi"), F.lit("")))
    work = _trimmed(col("e.id"))
    day = _trimmed(col("e.publication_date"))
    year = F.coalesce(F.nullif(col("e.publication_year"), F.lit(0)), F.nullif(col("e.year"), F.lit(0)))
    cited = F.when(col("e.cited_by_count").rlike(r"^-?\d+$"), col("e.cited_by_count"))

    def address(c: Column, home: str) -> Column:
        return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(home), c))

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value)

    summary = F.concat_ws(
        ". ",
        blank_to_null("e.abstract"),
        part("DOI", blank_to_null(doi)),
        part("Citation count", cited),
        F.when(day != "", part("Publication date", day)).otherwise(part("Publication year", year.cast("string"))),
        part("OpenAlex ID", blank_to_null(work)),
    )
    published = F.when(day != "", iso_timestamp(day)).otherwise(_first_of_year(year))
    is_snapshot = F.coalesce(F.try_element_at(col("config"), F.lit("event_model")) == "citation_snapshot", F.lit(False))
    return _finish(
        rows.withColumns(
            {
                "title": F.coalesce(*[blank_to_null(f"e.{c}") for c in ("display_title", "display_name", "title")], F.lit("")),
                "link": F.when(doi != "", address(doi, "https://doi.org/"))
                .when(work != "", address(work, "https://openalex.org/"))
                .otherwise(F.lit("")),
                "summary": summary,
                "published": F.when(~is_snapshot, published),
            }
        )
    )


def registry_rows(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``items[]`` of a DOI registry; date parts default to the first month and day."""
    schema = "struct<items:array<struct<title:array<string>,DOI:string,abstract:string,published:struct<`date-parts`:array<array<int>>>>>>"
    rows = _entries(payloads, schema, lambda d: d["items"], _json, limit)
    parts = F.get(col("e.published")["date-parts"], F.lit(0))

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i))

    one = F.lit(1)
    published = F.try_make_timestamp(
        number(0), F.coalesce(number(1), one), F.coalesce(number(2), one), F.lit(0), F.lit(0), F.lit(0.0)
    )
    return _finish(
        rows.withColumns(
            {
                "title": F.coalesce(F.get("e.title", F.lit(0)), F.lit("")),
                "link": F.coalesce(_doi_link(col("e.DOI")), F.lit("")),
                "summary": text_or_empty("e.abstract"),
                "published": published,
            }
        )
    )


# Source type -> rows of its payloads.
NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    "rss": rss_rows,
    "arxiv": atom_paper_rows,
    "semantic_scholar": scholar_rows,
    "pubmed": feed_paper_rows,
    "biorxiv": preprint_rows,
    "openalex": works_rows,
    "crossref": registry_rows,
}
_XML_TYPES = ("rss", "arxiv", "pubmed")


def payload_errors(payloads: DataFrame) -> DataFrame:
    """``source, link, message`` of payloads of an unknown type or that cannot be read."""
    kind = F.lower("type")
    known = kind.isin(*NORMALISERS)
    is_xml = kind.isin(*_XML_TYPES)
    xml = F.from_xml(col("payload"), "struct<_corrupt_record:string>", {"mode": "PERMISSIVE"})
    broken = F.when(is_xml, xml["_corrupt_record"].isNotNull()).otherwise(
        F.try_parse_json("payload").isNull()
    )
    message = F.when(~known, F.concat(F.lit("Unsupported source type '"), col("type"), F.lit("'"))).when(
        broken | col("payload").isNull(), F.lit("Failed to parse payload")
    )
    bad = payloads.withColumn("_message", message).where(col("_message").isNotNull())
    return bad.select(
        "source", F.lit(None).cast("string").alias("link"), F.concat_ws(": ", "source", "_message").alias("message")
    )


def normalise_feeds(
    payloads: DataFrame, *, limit: int | None = None, types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of all payloads, the union of one branch per type, and the error rows."""
    if "config" not in payloads.columns:
        payloads = payloads.withColumn("config", F.expr("cast(map() as map<string,string>)"))
    rows = None
    for name in types or list(NORMALISERS):
        part = NORMALISERS[name](payloads.where(F.lower("type") == name), limit=limit)
        rows = part if rows is None else rows.unionByName(part)
    return rows, payload_errors(payloads)
