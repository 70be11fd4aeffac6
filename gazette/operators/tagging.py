"""Tagging of articles with a keyword dictionary.

Keywords are lower case and so is the text they are looked up in. An ASCII keyword matches as a whole word,
any other keyword as a part of the text. A whole-word match must cover complete word runs of the text, so a keyword is looked up by its first
word run (the anchor) in the set of word runs of the text, and only the keywords found that way are checked
any further.

Two plans give the same rows; the caller chooses. ``ROW_LOCAL`` makes the dictionary part of the projection, so no
row leaves its partition; ``JOINED``, for very large dictionaries, joins the exploded word runs with a table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import WORD, col, escape_regex, text_or_empty
from ..sources.config import Keyword

ROW_LOCAL, JOINED = "row_local", "joined"

_NAMES = ("entity", "pos", "keyword", "anchor", "pattern")


def _whole_word(keyword: str) -> str:
    start = rf"(?<!{WORD})" if re.match(r"\w", keyword) else rf"(?<={WORD})"
    end = rf"(?!{WORD})" if re.search(r"\w$", keyword) else rf"(?={WORD})"
    return f"{start}{escape_regex(keyword)}{end}"


def _entry(k: Keyword) -> tuple[str, int, str, str | None, str | None]:
    """Dictionary row: anchor NULL means every text is a candidate, pattern NULL means no further check."""
    if not k.keyword.isascii():
        return (*k, None, None)
    runs = re.findall(r"\w+", k.keyword)
    if not runs:
        return (*k, None, _whole_word(k.keyword))
    return (*k, runs[0], None if runs[0] == k.keyword else _whole_word(k.keyword))


def tag_text(title: Column | str, summary: Column | str) -> Column:
    return F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(summary))


def word_runs(lowered: Column) -> Column:
    """Word runs of a lower-cased text."""
    return F.split(lowered, f"[^{WORD[1:-1]}]+")


def _verified(lowered: Column, anchor: Column, keyword: Column, pattern: Column) -> Column:
    """A cheap substring test first; the pattern then looks at the ends of the match."""
    return (
        F.when(pattern.isNotNull(), lowered.contains(keyword) & F.regexp_like(lowered, pattern))
        .when(anchor.isNull(), lowered.contains(keyword))
        .otherwise(F.lit(True))
    )


def _split(entries: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    return [e for e in entries if e[3] is not None], [e for e in entries if e[3] is None]


def _found_anchors(words: Column, entries: list[tuple]) -> Column:
    anchors = sorted({e[3] for e in entries if e[3] is not None})
    return F.array_intersect(words, F.array(*[F.lit(a) for a in anchors]).cast("array<string>"))


def _literal(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast("int" if n == "pos" else "string").alias(n) for n, v in zip(_NAMES, r)]) for r in rows])


def _dictionary(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """The entries as a table; from Arrow its size is known, so a small one is broadcast."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return spark.createDataFrame(pa.table({n: pa.array(v, k) for n, v, k in zip(_NAMES, zip(*entries), kinds)}))


def _hits_in_row(lowered: Column, found: Column, entries: list[tuple]) -> Column:
    anchored, free = _split(entries)
    hits = []
    if anchored:
        hits.append(
            F.when(
                F.size(found) > 0,
                F.filter(
                    _literal(anchored),
                    lambda d: F.array_contains(found, d["anchor"])
                    & _verified(lowered, d["anchor"], d["keyword"], d["pattern"]),
                ),
            ).otherwise(F.filter(_literal(anchored[:1]), lambda d: F.lit(False)))
        )
    if free:
        hits.append(
            F.filter(_literal(free), lambda d: _verified(lowered, d["anchor"], d["keyword"], d["pattern"]))
        )
    pairs = [F.transform(h, lambda d: F.struct(d["pos"], d["entity"], d["keyword"])) for h in hits]
    return F.array_sort(pairs[0] if len(pairs) == 1 else F.concat(*pairs))


def _entity_map(hits: Column) -> Column:
    """Entity -> hit keywords in dictionary order, entities in the order of their first hit."""
    names = F.array_distinct(F.transform(hits, lambda h: h["entity"]))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n, F.transform(F.filter(hits, lambda h: h["entity"] == n), lambda h: h["keyword"])
            ),
        )
    )


def tag_articles(
    articles: DataFrame,
    dictionary: Sequence[Keyword],
    *,
    key: str = "link",
    plan: str = ROW_LOCAL,
) -> DataFrame:
    """Articles with ``matched_entities`` replaced by the hits of the dictionary."""
    entries = [_entry(k) for k in dictionary if k.keyword]
    rest = articles.drop("matched_entities")
    if not entries:
        return rest.withColumn("matched_entities", F.expr("cast(map() as map<string,array<string>>)"))
    if plan == ROW_LOCAL:
        staged = rest.withColumn("_lowered", F.lower(tag_text("title", "summary")))
        staged = staged.withColumn("_found", _found_anchors(word_runs(col("_lowered")), entries))
        staged = staged.withColumn("_hits", _hits_in_row(col("_lowered"), col("_found"), entries))
        return staged.withColumn("matched_entities", _entity_map(col("_hits"))).drop("_lowered", "_found", "_hits")
    return _tag_by_join(rest, entries, key)


def _tag_by_join(articles: DataFrame, entries: list[tuple], key: str) -> DataFrame:
    """Only keys and words meet the dictionary; a text then meets once what the words of its key found there."""
    anchored, free = _split(entries)
    rows = articles.withColumn("_lowered", F.lower(tag_text("title", "summary")))
    tried = []
    if anchored:
        dictionary = _dictionary(articles.sparkSession, anchored)
        listed = dictionary.groupBy("anchor").agg(F.collect_list(F.struct("entity", "pos", "keyword", "anchor", "pattern")).alias("entries"))
        words = rows.where(col(key).isNotNull()).select(key, F.explode(F.array_distinct(word_runs(col("_lowered")))).alias("anchor"))
        # A set, as several rows of a key may have the same word.
        found = words.join(listed, "anchor").groupBy(key).agg(F.flatten(F.collect_set("entries")).alias("_listed"))
        rows = rows.join(found, key, "left")
        # Asked twice, so that it is a column and not worked out anew for each entry.
        rows = rows.withColumn("_own", F.array_intersect(word_runs(col("_lowered")), F.transform("_listed", lambda d: d["anchor"])))
        none = F.filter(_literal(anchored[:1]), lambda d: F.lit(False))
        held = F.filter("_listed", lambda d: F.array_contains("_own", d["anchor"]) & _verified(col("_lowered"), d["anchor"], d["keyword"], d["pattern"]))
        tried.append(F.when(F.size("_own") > 0, held).otherwise(none))
    if free:
        # Keywords without an anchor are tried on each text where it lies; they never pair rows up.
        tried.append(F.filter(_literal(free), lambda d: _verified(col("_lowered"), d["anchor"], d["keyword"], d["pattern"])))
    hits = [F.transform(h, lambda d: F.struct(d["pos"], d["entity"], d["keyword"])) for h in tried]
    rows = rows.withColumn("_hits", F.when(col(key).isNotNull(), hits[0] if len(hits) == 1 else F.concat(*hits)))
    # Rows of one key share their hits. They lie together already, so the window moves no text again.
    rows = rows.withColumn("_hits", F.array_sort(F.flatten(F.collect_list("_hits").over(W.partitionBy(key)))))
    return rows.withColumn("matched_entities", _entity_map(col("_hits"))).select(*articles.columns, "matched_entities")


def entity_rows(tagged: DataFrame, *keep: Column | str) -> DataFrame:
    """One row per article and entity with its ``keywords``.

    The outer form keeps Spark from deriving a filter on the map, for which it would compute the tags a second
    time below the projection.
    """
    rows = tagged.select(*keep, F.explode_outer("matched_entities").alias("entity", "keywords"))
    return rows.where("entity is not null")


def keyword_totals(tagged: DataFrame) -> DataFrame:
    """Hits per entity and keyword; a keyword listed twice counts twice."""
    return (
        entity_rows(tagged)
        .select("entity", F.explode_outer("keywords").alias("keyword"))
        .groupBy("entity", "keyword")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def entity_json(tagged: DataFrame) -> DataFrame:
    """Articles with the entity map as JSON text in ``entities_json``."""
    return tagged.withColumn("entities_json", F.to_json("matched_entities"))
