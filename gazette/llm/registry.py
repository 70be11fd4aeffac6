"""The queries of this package over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gazette.llm import (
    bpe,
    divergence,
    exact_dedup,
    jaccard,
    langid,
    mixing,
    multi_index,
    pseudonyms,
    quality,
    sharding,
    substring,
    toxicity,
    whitening,
)
from gazette.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ranks_file() -> bytes:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read()


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), ranks_file(), public_tokenizers.PATTERN)


#: Texts without ASCII white space, as the operator compares them.
PLAIN = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


@query(
    "op5_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({PLAIN}) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


@query("op8_repetition_coverage")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(documents(spark, sf_dir))


def _sha_number(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _shard_sql(shards: int) -> str:
    tree = sharding.Tree.balanced(shards)

    def edges(tree: sharding.Tree) -> str:
        return ", ".join(f"('{a}', '{b}', {w})" for a, children in tree.nodes.items() for b, w in children)

    def walk(name: str, edge: str) -> str:
        draw = f"-ln(({_sha_number(chr(39).join(['key || ', '|', ' || child']), 13)} + 0.5) / 4503599627370496.0) / weight"
        steps = [f"{name}0 AS (SELECT key, '' AS node FROM (SELECT DISTINCT key FROM d))"]
        steps += [f"{name}{k} AS (SELECT key, arg_min(child, {draw}) AS node FROM {name}{k - 1} JOIN {edge} ON parent = node GROUP BY key)" for k in (1, 2, 3)]
        return ", ".join(steps)

    return f"""
    WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(doc_id::VARCHAR, '') AS key,
                      hex(encode(coalesce(text, ''))) AS bytes FROM documents),
         e1(parent, child, weight) AS (VALUES {edges(tree)}), e2(parent, child, weight) AS (VALUES {edges(tree.with_shard(shards))}),
         {walk("a", "e1")}, {walk("b", "e2")},
         c AS (SELECT d.doc_id, size, key, split_part(a3.node, '/', 3)::INT AS shard, split_part(b3.node, '/', 3)::INT AS grown_shard,
                      xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size - 7), lambda i: ('0x' || substr(bytes, 2 * i - 1, 2))::BIGINT)),
                          lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1]))) AS text_crc32
               FROM d JOIN a3 USING (key) JOIN b3 USING (key))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY {_sha_number("key", 3)}, doc_id, text_crc32, size) - 1 AS slot
    FROM c
    """


@query("op3_hash_tree_shards", _shard_sql(24))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hash_tree_shards(documents(spark, sf_dir), 24)


MIX_SQL = f"""
    WITH RECURSIVE
    d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                 {_sha_number("coalesce(doc_id::VARCHAR, '')", 15)} AS k FROM documents),
    s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][rank % 3 + 1]::DOUBLE AS weight, [1.5, 1.0, 0.5][rank % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][rank % 3 + 1]::DOUBLE AS b,
                 2 * source_size::DOUBLE AS cap FROM s),
    l AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS demand,
                 sum(cap) OVER f - cap AS before, sum(weight) OVER () - sum(weight) OVER f + weight AS rest
          FROM w WINDOW f AS (ORDER BY cap / weight, rank)),
    t AS (SELECT source, source_size, a, b,
                 least(cap, weight * coalesce((SELECT arg_min((demand - before) / rest, (ratio, rank)) FROM l WHERE (demand - before) / rest <= ratio), 0.0)) AS target FROM l),
    o AS (SELECT d.*, t.* EXCLUDE (source), floor(target)::BIGINT AS goal,
                 sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, greatest(0, least(size, goal - start)) AS t1, greatest(0, least(size, goal - start - source_size)) AS t2 FROM o),
    q AS (SELECT *, start::DOUBLE / target AS x1, (start + source_size)::DOUBLE / target AS x2 FROM p)
    SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (t1 + t2)::BIGINT AS taken,
           CASE WHEN t1 > 0 THEN floor((CASE WHEN a = b THEN x1 ELSE (sqrt(a * a + (b * b - a * a) * x1) - a) / (b - a) END) * 1e12)::BIGINT END AS time_1,
           CASE WHEN t2 > 0 THEN floor((CASE WHEN a = b THEN x2 ELSE (sqrt(a * a + (b * b - a * a) * x2) - a) / (b - a) END) * 1e12)::BIGINT END AS time_2
    FROM q
"""


@query("op9_curriculum_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(documents(spark, sf_dir))


@query("op2_language_profiles")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(documents(spark, sf_dir))


@query("op6_toxicity_grammar")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(documents(spark, sf_dir), 13)


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir))


@query("op10_feistel_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), b"a key for the given tables")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _divergence_sql(least: int, top: int) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
         c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
         k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {least}),
         l AS (SELECT lang, count(*) AS kinds, sum(total) AS lang_total FROM k GROUP BY lang),
         o AS (SELECT lang, source, sum(n) AS own_total FROM c JOIN k USING (lang, term) GROUP BY ALL),
         g AS (SELECT lang, source, coalesce(kinds, 0) AS kinds, coalesce(lang_total, 0) AS lang_total, coalesce(own_total, 0) AS own_total
               FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN o USING (lang, source)),
         x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5) // (own_total + 5 * kinds) AS p,
                      1 + 1000000000 * (total + 5) // (lang_total + 5 * kinds) AS q
               FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
         f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
               FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
               UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM r QUALIFY part = 'pair' OR rank <= {top}
    """


@query("op11_source_divergence", _divergence_sql(30, 50))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


@query("op12_feast_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_multi_index")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))
