"""Queries on full-text search and query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import col, collapse_spaces
from ..operators import recency
from ..operators import search as ops
from ..session import shared_folder
from ..sources.search_index import SearchIndex
from .articles import PAPERS, _papers
from .base import ARTICLES, AS_OF, AS_OF_SQL, articles_view, register, stamp, table

WORDS = (
    ARTICLES
    + """,
words_v AS MATERIALIZED (
  SELECT link AS doc_key, title, source, collected_at,
         regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+') AS tt,
         regexp_extract_all(strip_accents(lower(summary)), '[\\p{L}\\p{N}]+') AS ta,
         regexp_extract_all(strip_accents(lower(array_to_string(authors, ' '))), '[\\p{L}\\p{N}]+') AS tu
  FROM articles_v
),
all_v AS MATERIALIZED (SELECT *, list_concat(tt, ta, tu) AS words FROM words_v)"""
)


def _queries(spark, *texts: str):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def _documents(spark, folder):
    return ops.search_documents(articles_view(spark, folder))


def _has(word: str) -> str:
    return f"list_contains(words, '{word}')"


def _limited(*conditions: str, limit: int = 50) -> str:
    """Documents per query in key order."""
    parts = [
        f"SELECT {i} AS query_id, doc_key, row_number() OVER (ORDER BY doc_key) AS rank FROM all_v WHERE {c}"
        for i, c in enumerate(conditions)
    ]
    return f"WITH {WORDS} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {limit}"


_INDEXES: dict[tuple[str, str, str], str] = {}
_PARTS = 16


def _stored(spark, folder, name, build) -> SearchIndex:
    """An index that is built once in a session, as searches read what ingest runs have stored."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _INDEXES:
        index = SearchIndex(spark, shared_folder(spark, f"index-{name}"), parts=_PARTS)
        build(index)
        _INDEXES[key] = index.root
    return SearchIndex(spark, _INDEXES[key], parts=_PARTS)


def _index(spark, folder) -> SearchIndex:
    return _stored(spark, folder, "articles", lambda index: index.upsert(_documents(spark, folder)))


def _search(spark, folder, *texts):
    return _index(spark, folder).search(_queries(spark, *texts), limit=50)


@register(f"WITH {WORDS}, w AS (SELECT doc_key, unnest(words) AS term FROM all_v) "
          "SELECT term, count(DISTINCT doc_key) AS documents, count(*) AS occurrences FROM w GROUP BY term")
def postings_stats(spark, folder):
    """From the postings; the counts that the index keeps are those of index_upserts."""
    return ops.postings_stats(_index(spark, folder).postings())


#: What is left after the changes below: two thirds at first, then a third and newer versions, then a fifth deleted.
CHANGED = """changed_v AS MATERIALIZED (SELECT doc_key, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN list_concat(['newer'], tt) ELSE tt END AS tt, ta, tu
  FROM words_v JOIN (SELECT doc_id, link FROM articles_v) ON link = doc_key WHERE doc_id % 5 > 0),
changed_words AS (SELECT doc_key, list_concat(tt, ta, tu) AS words FROM changed_v)"""


def _changed(spark, folder) -> SearchIndex:
    def build(index: SearchIndex) -> None:
        rows = articles_view(spark, folder)
        third, half, fifth = (col("doc_id") % n == 0 for n in (3, 2, 5))
        index.upsert(ops.search_documents(rows.where(~third)))
        newer = rows.where(third | half).withColumn("title", F.concat(F.lit("Newer "), "title"))
        index.upsert(ops.search_documents(newer))
        index.delete(ops.search_documents(rows.where(fifth)))

    return _stored(spark, folder, "changed", build)


@register(f"""WITH {WORDS}, {CHANGED}, w AS (SELECT doc_key, unnest(words) AS term FROM changed_words)
SELECT term, count(DISTINCT doc_key) AS documents, count(*) AS occurrences, (SELECT count(*) FROM changed_words) AS n,
  (SELECT sum(len(words))::BIGINT FROM changed_words) AS words FROM w GROUP BY term""")
def index_upserts(spark, folder):
    """Counts of terms and of the corpus after two upserts and a delete, as kept by the batches."""
    index = _changed(spark, folder)
    sums = index._sums().select(col("documents").alias("n"), "words")
    return index.terms().join(F.broadcast(sums))


@register(f"""WITH {WORDS}, {CHANGED} SELECT * FROM (
SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS rank FROM (
  SELECT 0 AS query_id, doc_key FROM changed_words WHERE list_contains(words, 'license')
  UNION ALL SELECT 1, doc_key FROM changed_v WHERE tt[1] = 'newer' AND list_contains(ta, 'avec')
  UNION ALL SELECT 2, doc_key FROM changed_words WHERE list_contains(words, 'the') AND NOT list_contains(words, 'newer'))) WHERE rank <= 40""")
def index_changed_search(spark, folder):
    """Searches of the index after its changes."""
    queries = _queries(spark, "license", "title: ^newer abstract: avec", "the NOT newer")
    return _changed(spark, folder).search(queries, limit=40)


@register(_limited(f"{_has('mit')} AND {_has('license')}", f"{_has('fur')} AND {_has('und')}", _has("cion")))
def search_all_terms(spark, folder):
    return _search(spark, folder, "MIT license", "für AND und", "ción")


@register(_limited(f"{_has('mit')} OR {_has('gnu')}", f"{_has('fur')} OR {_has('cion')} OR ({_has('avec')} AND {_has('la')})"))
def search_any_term(spark, folder):
    return _search(spark, folder, "mit OR gnu", "für OR ción OR avec la")


@register(_limited(f"{_has('license')} AND NOT {_has('mit')}", f"{_has('the')} AND {_has('of')} AND NOT ({_has('license')} AND {_has('cc')})",
                   f"{_has('avec')} OR ({_has('the')} AND NOT {_has('was')})"))
def search_not(spark, folder):
    return _search(spark, folder, "license NOT mit", "the AND of NOT license cc", "avec OR the NOT was")


@register(_limited("len(list_filter(words, lambda x: starts_with(x, 'licen'))) > 0 AND " + _has("the"), "list_contains(tt, 'the')",
                   "len(list_filter(tt, lambda x: starts_with(x, 'thon'))) > 0"))
def search_prefix_and_field(spark, folder):
    return _search(spark, folder, "licen* the", "title:the", "title : thon*")


def _phrase(words: str) -> str:
    return " OR ".join(f"contains(' ' || array_to_string({t}, ' ') || ' ', ' {words} ')" for t in ("tt", "ta", "tu"))


@register(_limited(_phrase("mit license"), f"({_phrase('gnu general public')}) AND {_has('version')}", f"{_has('the')} AND NOT ({_phrase('of the')})"))
def search_phrase(spark, folder):
    return _search(spark, folder, '"MIT license"', '"GNU general public" version', 'the NOT "of the"')


def _bm25(query_id: int, words: list[str], where: str = "true", limit: int = 20) -> str:
    """Documents with all the words by BM25 in the published form, best first."""
    scores = " + ".join(
        f"-(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END)"
        f" * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))"
        for i in range(len(words))
    )
    counts = ", ".join(f"len(list_filter(words, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    stats = ", ".join(f"(SELECT count(*) FROM all_v WHERE {_has(w)}) AS d{i}" for i, w in enumerate(words))
    held = " AND ".join(_has(w) for w in words)
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score, doc_key) AS rank FROM ("
        f"SELECT {query_id} AS query_id, doc_key, round({scores}, 9) AS score FROM ("
        f"SELECT doc_key, collected_at, len(words) AS length, {counts}, (SELECT count(*) FROM all_v) AS n, "
        f"(SELECT avg(len(words)) FROM all_v) AS mean, {stats} FROM all_v WHERE {held}) WHERE {where})) WHERE rank <= {limit}"
    )


def _near(a: str, b: str, distance: int, lists: tuple[str, ...] = ("tt", "ta", "tu")) -> str:
    """Two words of a field with at most so many others between them."""

    def places(t: str, w: str) -> str:
        return f"list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{w}')"

    return "(" + " OR ".join(
        f"len(list_filter({places(t, a)}, lambda x: len(list_filter({places(t, b)}, lambda y: abs(x - y) - 1 <= {distance})) > 0)) > 0" for t in lists
    ) + ")"


@register(_limited(f"({_has('mit')} OR {_has('gnu')}) AND {_has('license')}", f"{_has('the')} AND NOT ({_has('license')} OR ({_has('cc')} AND NOT {_has('by')}))",
                   f"({_has('avec')} OR list_contains(tt, 'the')) AND ({_has('la')} OR {_has('of')})"))
def search_grammar(spark, folder):
    """Parentheses within parentheses, and columns over a whole expression."""
    return _search(spark, folder, "(mit OR gnu) AND license", "the NOT (license OR (cc NOT by))", "(avec OR title:(the)) AND (la OR of)")


@register(_limited(_near("the", "license", 3), _near("of", "the", 0), f"{_near('avec', 'la', 10)} AND NOT {_near('avec', 'la', 1)}",
                   f"{_near('general', 'the', 5, ('ta',))} OR {_near('mit', 'license', 2)}"))
def search_near(spark, folder):
    return _search(spark, folder, "NEAR(the license, 3)", "NEAR(of the, 0)", "NEAR(avec la) NOT NEAR(avec la, 1)", "abstract: NEAR(general the, 5) OR NEAR(mit license, 2)")


@register(_limited("tt[1] = 'the' OR ta[1] = 'the' OR tu[1] = 'the'", "(list_contains(tt, 'the') OR list_contains(tu, 'the')) AND list_contains(ta, 'license')",
                   "(list_contains(ta, 'author') OR list_contains(tu, 'author')) AND NOT list_contains(tt, 'the')", f"{_phrase('gnu general')}"))
def search_columns(spark, folder):
    """The first word of a field, sets of fields and their complement, and words joined to a phrase."""
    return _search(spark, folder, "^the", "{title authors}: the AND abstract: license", "- title: author NOT title: the", "gnu + general")


@register(f"WITH {WORDS} SELECT query_id, doc_key, round(score, 6) AS score, rank FROM ({_bm25(0, ['license'])} UNION ALL {_bm25(1, ['avec', 'la'])} UNION ALL {_bm25(2, ['the'])})")
def search_ranked(spark, folder):
    rows = _index(spark, folder).ranked(_queries(spark, "license", "avec la", "the"), limit=20)
    return rows.select("query_id", "doc_key", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {WORDS} SELECT query_id, doc_key, round(score, 6) AS score, rank FROM ("
          f"{_bm25(0, ['license'], f'collected_at >= {AS_OF_SQL} - INTERVAL 2 DAY', 5)} UNION ALL "
          f"{_bm25(1, ['avec'], f'collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY', 3)} UNION ALL {_bm25(2, ['gnu'])})")
def search_window(spark, folder):
    asked = ops.timed_queries(_queries(spark, "최근 2일 license 5개", "last 1 day avec top 3", "gnu"), limit=20)
    hits = _index(spark, folder).scored(asked.select("query_id", "query"))
    rows = ops.top_in_window(hits, articles_view(spark, folder), asked, as_of=AS_OF)
    return rows.select("query_id", "doc_key", F.round("score", 6).alias("score"), "rank")


@register(f"""WITH {PAPERS}, docs AS (SELECT coalesce(doi, arxiv_id, link) AS doc_key, title, link AS url, source,
  CASE WHEN arxiv_id IS NOT NULL THEN 'arXiv:' || arxiv_id WHEN doi IS NOT NULL THEN 'DOI:' || doi ELSE '' END AS id_tag,
  list_contains(regexp_extract_all(strip_accents(lower(title || ' ' || summary)), '[\\p{{L}}\\p{{N}}]+'), 'license') AS hit FROM papers_v),
hits AS (SELECT doc_key, row_number() OVER (ORDER BY doc_key) AS rank FROM docs WHERE hit)
SELECT 0 AS query_id, h.doc_key, h.rank, d.title, d.url, d.source, d.id_tag FROM hits h LEFT JOIN docs d USING (doc_key) WHERE h.rank <= 30""")
def search_enriched(spark, folder):
    papers = _papers(spark, folder)
    index = _stored(spark, folder, "papers", lambda index: index.upsert(ops.search_documents(papers)))
    return ops.enrich_hits(index.search(_queries(spark, "license"), limit=30), papers)


@register(f"WITH {WORDS} SELECT 0 AS query_id, doc_key AS link, rank FROM (SELECT *, row_number() OVER (ORDER BY doc_key) AS rank FROM all_v WHERE {_has('license')}) "
          f"WHERE rank <= 50 AND collected_at >= {AS_OF_SQL} - INTERVAL 1 DAY")
def recent_hits_semi(spark, folder):
    hits = _search(spark, folder, "license").withColumnRenamed("doc_key", "link")
    return recency.recent_hits(hits, articles_view(spark, folder), as_of=AS_OF, days=1)


@register(f"WITH {PAPERS} SELECT coalesce(doi, arxiv_id, link) AS doc_key, title, summary AS abstract, array_to_string(authors, ' ') AS authors FROM papers_v")
def search_documents(spark, folder):
    return ops.search_documents(_papers(spark, folder))


_ASKED = {0: [("license", 1)], 1: [("avec", 1), ("la", 1)], 2: [("thon%", 1)], 3: [("mit license", 2)]}
_ASKED_HITS = _limited(_has("license"), f"{_has('avec')} AND {_has('la')}", "len(list_filter(words, lambda x: starts_with(x, 'thon'))) > 0", _phrase("mit license"))
_ASKED_ROWS = ", ".join(f"({q}, {c}, '{w}', {n})" for q, asked in _ASKED.items() for c, (w, n) in enumerate(asked))
_PIECE = r"[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\x{0300}-\x{036f}]*"


@register(rf"""WITH {WORDS}, hits AS ({_ASKED_HITS}),
asked(query_id, clause, word, n) AS (VALUES {_ASKED_ROWS}),
texts AS (SELECT link AS doc_key, title, coalesce(summary, '') AS summary, array_to_string(authors, ' ') AS authors FROM articles_v),
fields AS (SELECT doc_key, 0 AS f, tt AS words, title AS text FROM words_v JOIN texts t USING (doc_key, title) UNION ALL SELECT doc_key, 1, ta, summary FROM words_v JOIN texts USING (doc_key)
  UNION ALL SELECT doc_key, 2, tu, authors FROM words_v JOIN texts USING (doc_key)),
places AS (SELECT doc_key, f, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS start, words FROM fields),
found AS (SELECT query_id, clause, doc_key, f, start, n FROM places p JOIN asked a
  ON CASE WHEN a.n = 2 THEN p.word || ' ' || coalesce(p.words[start + 2], '') = a.word WHEN ends_with(a.word, '%') THEN p.word LIKE a.word ELSE p.word = a.word END),
runs AS (SELECT a.query_id, a.doc_key, a.f, a.start, a.n, count(DISTINCT b.clause) AS kinds, count(*) AS many, list(b.start) AS marks
  FROM (SELECT DISTINCT query_id, doc_key, f, start, n FROM found) a JOIN found b
    ON a.query_id = b.query_id AND a.doc_key = b.doc_key AND a.f = b.f AND b.start BETWEEN a.start AND a.start + 9 GROUP BY ALL),
best AS (SELECT r.*, regexp_extract_all(text, '{_PIECE}') AS pieces
  FROM runs r JOIN fields USING (doc_key, f) QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY kinds DESC, many DESC, f, start) = 1),
cut AS (SELECT *, greatest(least(start, len(pieces) - 10), 0) AS b FROM best),
shown AS (SELECT *, list_transform(range(b, least(b + 10, len(pieces))), lambda k:
    CASE WHEN list_contains(marks, k) THEN regexp_replace(pieces[k + 1], '^([^\p{{L}}\p{{N}}]*)', '\1<b>') ELSE pieces[k + 1] END
    || CASE WHEN list_contains(list_transform(marks, lambda m: least(m + n - 1, b + 9)), k) THEN '</b>' ELSE '' END) AS parts FROM cut)
SELECT h.query_id, h.doc_key, h.rank, CASE WHEN b > 0 THEN '...' ELSE '' END || trim(regexp_replace(array_to_string(parts, ''), '\s+', ' ', 'g'))
  || CASE WHEN b + 10 < len(pieces) THEN '...' ELSE '' END AS snippet FROM hits h LEFT JOIN shown s USING (query_id, doc_key)""")
def snippets(spark, folder):
    index, queries = _index(spark, folder), _queries(spark, "license", "avec la", "thon*", '"mit license"')
    return index.snippets(index.search(queries, limit=50), _documents(spark, folder), queries)


_LOG = """log_v AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, conv_id % 9 + 1 AS n FROM conversations WHERE role = 'user'),
asked AS (SELECT *, CASE conv_id % 6 WHEN 0 THEN '최근 ' || n || '일 ' || t WHEN 1 THEN '지난 ' || n || '개월  ' || t || ' ' || n || '개' WHEN 2 THEN 'last ' || n || ' weeks ' || t
  WHEN 3 THEN 'Top ' || n || ' ' || t WHEN 4 THEN t || ' ' || n || '개' ELSE t END AS query FROM log_v)"""


def _query_log(spark, folder):
    rows = table(spark, folder, "conversations").where("role = 'user'")
    t = collapse_spaces("text")
    n = (col("conv_id") % 9 + 1).cast("string")
    kind = col("conv_id") % 6
    query = (
        F.when(kind == 0, F.concat(F.lit("최근 "), n, F.lit("일 "), t))
        .when(kind == 1, F.concat(F.lit("지난 "), n, F.lit("개월  "), t, F.lit(" "), n, F.lit("개")))
        .when(kind == 2, F.concat(F.lit("last "), n, F.lit(" weeks "), t))
        .when(kind == 3, F.concat(F.lit("Top "), n, F.lit(" "), t))
        .when(kind == 4, F.concat(t, F.lit(" "), n, F.lit("개")))
        .otherwise(t)
    )
    return rows.select("conv_id", "turn", query.alias("query"))


@register(f"""WITH {_LOG} SELECT conv_id, turn, query, t AS search_text,
  CASE conv_id % 6 WHEN 0 THEN n WHEN 1 THEN n * 30 WHEN 2 THEN n * 7 END AS days,
  CASE WHEN conv_id % 6 IN (1, 3, 4) THEN n END AS max_results, NULL::VARCHAR AS category FROM asked""")
def query_log_parse(spark, folder):
    return ops.parse_queries(_query_log(spark, folder))


def _intent(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")"


@register(f"WITH {_LOG} " + " UNION ALL ".join(f"SELECT '{n}' AS intent, count(*) FILTER ({_intent(w)}) AS n FROM asked" for n, w in ops.INTENTS.items()))
def query_intents(spark, folder):
    return ops.intent_counts(_query_log(spark, folder))
