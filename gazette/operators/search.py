"""Full-text search over documents: an inverted index, and batches of queries as joins on it.

``postings`` has one row per occurrence of a term: document, field and position. It needs no grouping to be
built; :mod:`gazette.sources.search_index` stores it sorted by term and keeps it current.
A batch of queries becomes a table of clauses that is joined with the postings by term, so the cost of a
search is the size of the posting lists it touches; what a document holds then decides by the program of the query.
The grammar is that of :mod:`gazette.functions.match_text`; text outside it finds nothing and is an error row.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.match_text import parsed_query
from ..functions.text import blank_to_null, col, collapse_spaces, search_tokens, text_or_empty
from ..session import shared_folder

FIELDS = ("title", "abstract", "authors")

# BM25 weights, and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def search_documents(papers: DataFrame) -> DataFrame:
    """``doc_key, title, abstract, authors``: the key is the DOI, else the arXiv id, else the link."""
    names = set(papers.columns)

    def optional(name: str) -> Column:
        return blank_to_null(name) if name in names else F.lit(None).cast("string")

    authors = F.array_join("authors", " ") if "authors" in names else F.lit("")
    return papers.select(
        F.coalesce(optional("doi"), optional("arxiv_id"), col("link")).alias("doc_key"),
        text_or_empty("title").alias("title"),
        F.coalesce(optional("abstract"), optional("summary"), F.lit("")).alias("abstract"),
        F.coalesce(authors, F.lit("")).alias("authors"),
    )


def _words(documents: DataFrame) -> list[tuple[str, Column]]:
    return [(f, search_tokens(f)) for f in FIELDS if f in documents.columns]


def postings(documents: DataFrame) -> DataFrame:
    """``term, doc_key, field, position`` of all words."""
    return word_places(documents.select("doc_key", field_words(documents).alias("fields")))


def field_words(documents: DataFrame) -> Column:
    """The words of each field of a document, as an array of ``field, words``."""
    return F.array(*[F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in _words(documents)])


def word_places(rows: DataFrame, *also: str) -> DataFrame:
    """One row per word of the column ``fields``."""
    fields = rows.select("doc_key", *also, F.explode_outer("fields").alias("t"))
    words = fields.select("doc_key", *also, "t.field", F.posexplode_outer("t.words").alias("position", "term"))
    return words.where("term is not null").select("term", "doc_key", "field", "position", *also)


def document_lengths(documents: DataFrame) -> DataFrame:
    total = sum((F.size(w) for _, w in _words(documents)), F.lit(0))
    return documents.select("doc_key", total.cast("bigint").alias("length"))


def postings_stats(posted: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    per_document = posted.groupBy("term", "doc_key").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")
    )


def parse_batch(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """``query_id, error, clauses, program`` of each query, written once: all parts of a search read it."""
    spark = queries.sparkSession
    read = queries.select("query_id", parsed_query(query, FIELDS).alias("q")).select("query_id", "q.*")
    worded = F.transform("clauses", lambda c: c.withField("words", search_tokens(c["text"])))
    place = shared_folder(spark, "queries")
    read.withColumn("clauses", worded).write.parquet(place)
    return spark.read.schema(read.withColumn("clauses", worded).schema).parquet(place)


def query_errors(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """``query_id, error`` of the queries that are not written by the grammar; they find nothing."""
    read = queries.select("query_id", parsed_query(query, FIELDS).alias("q"))
    return read.select("query_id", "q.error").where("error is not null")


_CLAUSE = ["query_id", "clause", "n_words", "first", "columns", "near", "distance"]


def query_clauses(parsed: DataFrame) -> DataFrame:
    """One row per word of each clause: ``offset`` is its place in a phrase, ``is_prefix`` a last word with a star."""
    rows = parsed.select("query_id", F.explode("clauses").alias("c")).select("query_id", "c.*")
    rows = rows.withColumn("n_words", F.size("words"))
    rows = rows.select(*_CLAUSE, "starred", F.posexplode("words").alias("offset", "term"))
    return rows.withColumn("is_prefix", col("starred") & (col("offset") == col("n_words") - 1)).drop("starred")


def _with_starts(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per start of ``term`` in the lengths that the prefixes of the batch have."""
    lengths = clauses.where("is_prefix").agg(F.sort_array(F.collect_set(F.length("term")))).scalar()
    fitting = F.filter("_lengths", lambda n: n <= F.length("term"))
    starts = F.transform(fitting, lambda n: F.substring(col("term"), F.lit(1), n))
    return rows.withColumn("_lengths", lengths).withColumn("_start", F.explode(starts)).drop("_lengths")


class Features(NamedTuple):
    """What the clauses of a batch ask for; steps that none asks for are left out of the plan."""

    prefixes: bool
    phrases: bool
    near: bool
    #: Clauses that are more than one word in any field.
    rich: bool


def _features(clauses: DataFrame) -> Features:
    plain = (col("n_words") == 1) & ~col("is_prefix") & ~col("first") & col("columns").isNull() & col("near").isNull()
    counts = [F.count_if("is_prefix"), F.count_if(col("n_words") > 1), F.count("near"), F.count_if(~plain)]
    return Features(*(n > 0 for n in clauses.agg(*counts).first()))


def _instances(posted: DataFrame, clauses: DataFrame, asked: Features) -> DataFrame:
    """Where each clause stands whole: ``query_id, doc_key, clause, near, distance, n_words, field, start`` and the
    further columns of the postings. A prefix is looked up among the starts of terms, so both joins are by equality."""
    also = [c for c in posted.columns if c not in ("term", "doc_key", "field", "position")]
    hits = posted.join(clauses.where(~col("is_prefix")), "term")
    if asked.prefixes:
        wanted = clauses.where("is_prefix").withColumnRenamed("term", "_start")
        hits = hits.unionByName(_with_starts(posted, clauses).join(wanted, "_start").drop("_start"))
    hits = hits.where(col("columns").isNull() | F.array_contains("columns", col("field")))
    hits = hits.withColumn("start", col("position") - col("offset")).where(~col("first") | (col("start") == 0))
    # A word of one place needs no company; the words of a phrase agree on where it starts.
    key = ["query_id", "doc_key", "clause", "near", "distance", "n_words", "field", "start", *also]
    if not asked.phrases:
        return hits.select(*key)
    one, more = hits.where("n_words = 1").select(*key), hits.where("n_words > 1")
    whole = more.groupBy(*key).agg(F.count(F.lit(1)).alias("_words")).where("_words = n_words").drop("_words")
    return one.unionByName(whole)


def _near_groups(placed: DataFrame, parsed: DataFrame) -> DataFrame:
    """``query_id, doc_key, clause``: the NEAR groups that a document holds in some field.

    Every instance may be the first of a group. Walking a field backwards, the next instance of each phrase is known
    at each place, so a group costs its instances times its phrases, however often they stand in a document.
    """
    groups = parsed.select("query_id", F.explode("clauses").alias("c")).where("c.near is not null")
    members = groups.select("query_id", "c.near", col("c.clause").alias("member"))
    rows = placed.where("near is not null").join(members, ["query_id", "near"])
    key = ["query_id", "near", "doc_key", "field"]
    back = W.partitionBy(*key, "member").orderBy(col("start").desc()).rangeBetween(W.unboundedPreceding, 0)
    own = F.when(col("clause") == col("member"), col("start"))
    # A phrase may follow from the word after the first one on; the first phrase itself counts where it stands.
    rows = rows.withColumn("next", F.last(own, ignorenulls=True).over(back))
    close = col("next") - (col("start") + col("n_words")) <= col("distance")
    each = rows.groupBy(*key, "start", "clause", "n_words").agg(F.count_if(close).alias("held"), F.count(F.lit(1)).alias("wanted"))
    return each.where("held = wanted").select("query_id", "doc_key", col("near").alias("clause")).distinct()


def _held(placed: DataFrame, parsed: DataFrame, *, near: bool) -> DataFrame:
    """``query_id, doc_key, held``: the clauses of a document with the number of their instances."""
    also = [c for c in placed.columns if c == "length"]
    counts = placed.groupBy("query_id", "doc_key", "clause", *also).agg(F.count(F.lit(1)).alias("n"))
    if near:
        groups = _near_groups(placed, parsed).withColumn("n", F.lit(0).cast("bigint"))
        counts = counts.unionByName(groups, allowMissingColumns=True)
    lengths = [F.max(c).alias(c) for c in also]
    return counts.groupBy("query_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("clause", "n"))).alias("held"), *lengths)


def _is_match() -> Column:
    """The program of a query run over the clauses that a document holds, on a stack.

    A clause without words is neither held nor missing: what stands beside it decides.
    """
    held = F.transform("held", lambda h: h["clause"])

    def step(stack: Column, op: Column) -> Column:
        a, b = F.element_at(stack, -2), F.element_at(stack, -1)
        left, right = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
        beside = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(left & right)
        joined = F.when(op["op"] == "and", left & right).when(op["op"] == "or", left | right).when(op["op"] == "not", left & ~right)
        rest = F.slice(stack, F.lit(1), F.size(stack) - 2)
        leaf = F.when(~F.array_contains("voids", op["clause"]), F.array_contains(held, op["clause"]))
        return F.when(op["op"] == "clause", F.concat(stack, F.array(leaf))).otherwise(
            F.concat(rest, F.array(F.when(op["op"] == "beside", beside).otherwise(joined)))
        )

    empty = F.expr("cast(array() as array<boolean>)")
    return F.coalesce(F.element_at(F.aggregate("program", empty, step), 1), F.lit(False))


def _matching(held: DataFrame, parsed: DataFrame) -> DataFrame:
    void = F.transform(F.filter("clauses", lambda c: (F.size(c["words"]) == 0) & c["near"].isNull()), lambda c: c["clause"])
    programs = parsed.where("size(program) > 0").select("query_id", "program", "clauses", void.alias("voids"))
    return held.join(programs, "query_id").where(_is_match()).drop("program", "voids")


_SALTS = 64


def _top(rows: DataFrame, order: list[Column], limit: int | str) -> DataFrame:
    """First rows per query with their ``rank``; the limit is a number or a column.

    Every query is first cut in ``_SALTS`` parts: what is among its first rows is among the first of its part, so a
    query that finds a third of all documents is no task of its own.
    """
    most = F.lit(limit) if isinstance(limit, int) else col(limit)
    parts = W.partitionBy("query_id", "_salt").orderBy(*order)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_key"), F.lit(_SALTS)))
    cut = salted.withColumn("rank", F.row_number().over(parts)).where(col("rank") <= most).drop("_salt", "rank")
    return cut.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(col("rank") <= most)


def search(posted: DataFrame, queries: DataFrame, *, limit: int = 50) -> DataFrame:
    """``query_id, doc_key, rank`` of the matching documents in the order of their keys."""
    return search_parsed(posted, parse_batch(queries), limit=limit)


def search_parsed(posted: DataFrame, parsed: DataFrame, *, limit: int = 50) -> DataFrame:
    clauses = query_clauses(parsed)
    asked = _features(clauses)
    found = _matching(_held(_instances(posted, clauses, asked), parsed, near=asked.near), parsed)
    return _top(found.select("query_id", "doc_key"), [col("doc_key")], limit)


def scored_parsed(posted: DataFrame, corpus: DataFrame, parsed: DataFrame, *, terms: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_key, score`` of the matching documents; the BM25 score is best when smallest.

    The postings carry the ``length`` of their document and ``corpus`` is one row ``n, mean``. With the stored counts
    ``terms`` a batch of single words is scored in one pass; other clauses are counted in the hits, which are then
    written once, as matching reads them too.
    """
    spark, clauses = posted.sparkSession, query_clauses(parsed)
    asked = _features(clauses)
    held = _held(_instances(posted, clauses, asked), parsed, near=asked.near)
    if terms is not None and not asked.rich:
        counts = clauses.select("query_id", "clause", "term").join(terms.select("term", col("documents").alias("df")), "term")
    else:
        place = shared_folder(spark, "hits")
        held.write.parquet(place)
        held = spark.read.schema(held.schema).parquet(place)
        each = held.select("query_id", F.explode("held").alias("h"))
        counts = each.groupBy("query_id", "h.clause").agg(F.count(F.lit(1)).alias("df"))
    frequencies = counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("clause", "df"))).alias("frequencies"))
    totals = corpus.agg(F.struct(F.max("n").alias("n"), F.max("mean").alias("mean"))).scalar()
    rows = _matching(held, parsed).join(frequencies, "query_id").withColumn("corpus", totals)
    held_clauses = F.transform("held", lambda h: h["clause"])

    def term(h: Column) -> Column:
        df = F.try_element_at("frequencies", h["clause"])
        idf = F.ln((col("corpus.n") - df + F.lit(0.5)) / (df + F.lit(0.5)))
        norm = F.lit(1 - B) + F.lit(B) * col("length") / col("corpus.mean")
        share = h["n"] * F.lit(K1 + 1) / (h["n"] + F.lit(K1) * norm)
        return -F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * share

    def counts_here(h: Column) -> Column:
        """Phrases of a NEAR group count where the group holds."""
        group = F.get(F.filter("clauses", lambda c: c["clause"] == h["clause"]), F.lit(0))["near"]
        return (h["n"] > 0) & (group.isNull() | F.array_contains(held_clauses, group))

    score = F.aggregate(F.transform(F.filter("held", counts_here), term), F.lit(0.0), lambda total, x: total + x)
    # Sums of doubles may differ in the last bits with the order of their parts, so those are cut off.
    return rows.select("query_id", "doc_key", F.round(score, 9).alias("score"))


def scored_hits(posted: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """As :func:`scored_parsed`, over postings without lengths."""
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    return scored_parsed(posted.join(lengths, "doc_key"), corpus, parse_batch(queries))


def ranked_search(posted: DataFrame, lengths: DataFrame, queries: DataFrame, *, limit: int = 50) -> DataFrame:
    """As :func:`search` with the score, best first."""
    return _top(scored_hits(posted, lengths, queries), [col("score"), col("doc_key")], limit)


def best_windows(placed: DataFrame, *, words: int) -> DataFrame:
    """``query_id, doc_key, field, begin, marks`` of the best run of ``words`` words of each hit.

    A run starts at an instance; it is best by the number of different clauses in it, then of instances, then by the
    order of the fields and by place. The counts slide along a field, so a document costs its instances.
    """
    key = ["query_id", "doc_key", "field"]
    run = W.partitionBy(*key).orderBy("start").rangeBetween(0, words - 1)
    places = placed.groupBy(*key, "start").agg(F.array_sort(F.collect_list(F.struct("clause", "n_words"))).alias("here"))
    rows = places.withColumn("inside", F.collect_list(F.struct("start", "here")).over(run))
    found = F.flatten(F.transform("inside", lambda x: F.transform(x["here"], lambda h: h["clause"])))
    spans = F.transform("inside", lambda x: F.struct(x["start"].alias("start"), F.array_max(F.transform(x["here"], lambda h: h["n_words"])).alias("n_words")))
    rank = F.array_position(F.array(*[F.lit(f) for f in FIELDS]), col("field"))
    order = F.struct((-F.size(F.array_distinct(found))).alias("a"), (-F.size(found)).alias("b"), rank.alias("c"), col("start").alias("d"))
    best = rows.withColumn("order", order).withColumn("marks", spans).groupBy("query_id", "doc_key")
    return best.agg(F.min_by(F.struct("field", col("start").alias("begin"), "marks"), "order").alias("w")).select("query_id", "doc_key", "w.*")


def marked_text(text: Column, begin: Column, marks: Column, words: int) -> Column:
    """``words`` words of a text from the first one shown on, with the marked runs in ``<b>`` and dots for what is left out.

    The run is moved back where the text ends before it is full.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036f]*"), F.lit(0))
    begin = F.greatest(F.least(begin, F.size(pieces) - words), F.lit(0))

    def covered(i: Column) -> Column:
        return F.exists(marks, lambda m: (m["start"] <= i) & (i < m["start"] + m["n_words"]))

    def goes_on(i: Column) -> Column:
        """Word ``i`` and the one before it belong to one run."""
        return F.exists(marks, lambda m: (m["start"] < i) & (i < m["start"] + m["n_words"]))

    def shown(piece: Column, k: Column) -> Column:
        i = begin + k
        opened = F.regexp_replace(piece, r"^([^\p{L}\p{N}]*)", "$1<b>")
        start, end = covered(i) & (~goes_on(i) | (k == 0)), covered(i) & (~goes_on(i + 1) | (k == words - 1))
        return F.concat(F.when(start, opened).otherwise(piece), F.when(end, F.lit("</b>")).otherwise(F.lit("")))

    text = collapse_spaces(F.array_join(F.transform(F.slice(pieces, begin + 1, F.lit(words)), shown), ""))
    before = F.when(begin > 0, F.lit("...")).otherwise(F.lit(""))
    after = F.when(begin + words < F.size(pieces), F.lit("...")).otherwise(F.lit(""))
    return F.concat(before, text, after)


def snippets(hits: DataFrame, posted: DataFrame, documents: DataFrame, queries: DataFrame, *, words: int = 10) -> DataFrame:
    """The best ``words`` words of any field around the clauses of each result, with phrases marked as a whole."""
    parsed = parse_batch(queries)
    clauses = query_clauses(parsed)
    shown = hits.select("query_id", "doc_key").distinct()
    placed = _instances(posted, clauses, _features(clauses)).join(shown, ["query_id", "doc_key"], "left_semi")
    best = best_windows(placed, words=words)
    fields = [f for f in FIELDS if f in documents.columns]
    text = F.coalesce(*[F.when(col("field") == f, text_or_empty(f)) for f in fields])
    shown = best.join(documents.select("doc_key", *fields), "doc_key")
    shown = shown.select("query_id", "doc_key", marked_text(text, col("begin"), col("marks"), words).alias("snippet"))
    return hits.join(shown, ["query_id", "doc_key"], "left").select(*hits.columns, "snippet")


def enrich_hits(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with the columns of their article and a tag of its identifier; no hit is lost."""
    keyed = papers.select(
        F.coalesce(blank_to_null("doi"), blank_to_null("arxiv_id"), col("link")).alias("doc_key"),
        "title",
        col("link").alias("url"),
        "source",
        F.when(blank_to_null("arxiv_id").isNotNull(), F.concat(F.lit("arXiv:"), col("arxiv_id")))
        .when(blank_to_null("doi").isNotNull(), F.concat(F.lit("DOI:"), col("doi")))
        .otherwise(F.lit(""))
        .alias("id_tag"),
    )
    return hits.join(keyed, "doc_key", "left")


# Time units of a query in days.
UNIT_DAYS = {"일": 1, "주": 7, "주일": 7, "개월": 30, "달": 30, "day": 1, "week": 7, "month": 30}

_KOREAN_WINDOW = r"(?:최근|지난)\s*(\d+)\s*(개월|주일|주|달|일)(?:간|동안)?"
_ENGLISH_WINDOW = r"(?i)\b(?:last|past|recent)\s+(\d+)\s*(day|week|month)s?\b"
_KOREAN_LIMIT = r"(\d+)\s*개(?!월)"
_ENGLISH_LIMIT = r"(?i)\btop\s+(\d+)\b"


def parse_queries(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """Adds ``search_text``, ``days``, ``max_results`` and ``category`` (always NULL) read from each query."""
    units = F.create_map(*[F.lit(v) for pair in UNIT_DAYS.items() for v in pair])
    raw = text_or_empty(query)

    def window(pattern: str) -> Column:
        number = F.regexp_extract(raw, pattern, 1).try_cast("bigint")
        return number * F.try_element_at(units, F.lower(F.regexp_extract(raw, pattern, 2)))

    rest = raw
    for pattern in (_KOREAN_WINDOW, _ENGLISH_WINDOW, _ENGLISH_LIMIT, _KOREAN_LIMIT):
        rest = F.regexp_replace(rest, pattern, " ")
    timeless = F.regexp_replace(raw, _KOREAN_WINDOW, " ")
    return queries.withColumns(
        {
            "search_text": collapse_spaces(rest),
            "days": F.coalesce(window(_KOREAN_WINDOW), window(_ENGLISH_WINDOW)),
            "max_results": F.coalesce(
                F.regexp_extract(timeless, _KOREAN_LIMIT, 1).try_cast("bigint"),
                F.regexp_extract(raw, _ENGLISH_LIMIT, 1).try_cast("bigint"),
            ),
            "category": F.lit(None).cast("string"),
        }
    )


# Intent of a query -> parts of its text that show it.
INTENTS = {
    "recent": ["recent", "latest", "new"],
    "citations": ["cited", "citations", "popular"],
    "author": ["by", "author", "from"],
    "venue": ["in", "venue", "conference", "journal"],
}


def query_intents(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """Adds one boolean column per intent."""
    text = F.lower(text_or_empty(query))
    return queries.withColumns({n: F.greatest(*[text.contains(w) for w in words]) for n, words in INTENTS.items()})


def intent_counts(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """Queries per intent."""
    flagged = query_intents(queries, query=query)
    row = flagged.agg(*[F.count_if(col(n)).alias(n) for n in INTENTS])
    pairs = F.array(*[F.struct(F.lit(n).alias("intent"), col(n).alias("n")) for n in INTENTS])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def timed_queries(queries: DataFrame, *, limit: int = 20) -> DataFrame:
    """``query_id, query, days, max_results`` of queries with a time window and a limit in their text."""
    text = F.coalesce(blank_to_null("search_text"), F.trim("query"))
    most = F.coalesce("max_results", F.lit(limit)).alias("max_results")
    return parse_queries(queries).select("query_id", text.alias("query"), "days", most)


def top_in_window(hits: DataFrame, articles: DataFrame, asked: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """The best scored hits of each query among the articles of its window; the window applies before the limit."""
    collected = articles.select(col("link").alias("doc_key"), "collected_at")
    dated = hits.join(asked.select("query_id", "days", "max_results"), "query_id").join(collected, "doc_key", "left")
    since = F.timestamp_add("DAY", -col("days").cast("int"), F.lit(as_of))
    kept = dated.where(col("days").isNull() | (col("collected_at") >= since))
    return _top(kept, [col("score"), col("doc_key")], "max_results").select("query_id", "doc_key", "score", "rank")


def windowed_search(
    posted: DataFrame,
    lengths: DataFrame,
    articles: DataFrame,
    queries: DataFrame,
    *,
    as_of: dt.datetime,
    limit: int = 20,
) -> DataFrame:
    """Search with the time window and the limit written in each query."""
    asked = timed_queries(queries, limit=limit)
    hits = scored_hits(posted, lengths, asked.select("query_id", "query"))
    return top_in_window(hits, articles, asked, as_of=as_of)
