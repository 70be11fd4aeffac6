"""How the sources of a language differ in their words.

Terms are runs of the letters A-Z, a-z and of all code points from 128 on, with A-Z lower-cased. Each language keeps the
terms that stand in ``least`` of its documents or more. A group (language, source) and a language give every kept term
the smoothed share ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, in whole numbers throughout.

1. Texts become counts in tasks, about ``REGROUP`` bytes at a time. Terms are packed by length: up to 8 bytes are one
   uint64 word, up to 16 bytes two; they are radix-sorted by 16 bits at a time and their runs counted. Longer terms lie
   in buckets of fixed width (32, 64, 128 ... bytes) that are sorted as bytes. Sorting is stable and texts come in the
   order of their groups, so a run's groups and documents stand together.
2. Counts are summed per (language, source, term), first in each task; a source that holds most rows costs one row per
   task and term.
3. Distances of all sources of a language: sources are numbered and dealt out in blocks, terms in ``SPLITS`` parts. One
   task run holds a matrix of two blocks of sources and adds up the distances of its terms as they come in; terms that
   neither block has are added at the end from the shares of a count of 0.

Defined cases: a null text, lang or source is an empty one; empty texts still make their group occur; rows are documents,
so repeated rows count each; ties are ordered by item; a language without kept terms has distances of 0 and no terms;
an empty table gives an empty result; other columns are not read. A text is never split: a very long one is worked on
alone and needs some 20 times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, stored, texts

REGROUP = 8 << 20
BLOCK = 256
SPLITS = 64
TOP = 50
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first n bytes of a word.
_FIRST = np.array([0, *((2**64 - 1) << 8 * (8 - n) & 2**64 - 1 for n in range(1, 9))], dtype=np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of keys of several uint64 words, the first the highest: 16 bits at a time from the lowest."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]
    return order


def _runs(order: np.ndarray, keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first member of each run of equal keys and group, its members and its documents."""
    group, doc = group[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


def term_counts(values: list[bytes], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms as bytes, group, occurrences, documents) by bucket, for texts in the order of their groups."""
    data = np.frombuffer(b" ".join([*values, bytes(16)]), dtype=np.uint8)
    edge = np.diff(np.concatenate(([False], _LETTER[data], [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.cumsum([len(v) + 1 for v in values]), start, side="right")
    data = _LOWER[data]
    size = end - start
    word = np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))
    for low, high in ((0, 8), (8, 16)):
        some = np.flatnonzero((size > low) & (size <= high))
        if not len(some):
            continue
        keys = [word[start[some]].astype(np.uint64) & _FIRST[np.minimum(size[some], 8)]]
        if low:
            keys.append(word[start[some] + 8].astype(np.uint64) & _FIRST[size[some] - 8])
        first, n, docs = _runs(radix_order(keys), keys, group[doc[some]], doc[some])
        packed = np.stack([k[first] for k in keys], axis=1).astype(">u8")
        yield packed.view(f"S{high}").ravel(), group[doc[some[first]]], n, docs
    width = 32
    while (size > width // 2).any():
        some = np.flatnonzero((size > max(width // 2, 16)) & (size <= width))
        if len(some):
            place = start[some][:, None] + np.arange(width)
            block = np.where(np.arange(width) < size[some][:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
            key = block.view(f"S{width}").ravel()
            first, n, docs = _runs(np.argsort(key, kind="stable"), [key], group[doc[some]], doc[some])
            yield key[first], group[doc[some[first]]], n, docs
        width *= 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs); a row without term for each group that occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def flush(rows: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = sorted(rows, key=lambda r: r[:2])
        found = sorted({r[:2] for r in rows})
        number = {g: i for i, g in enumerate(found)}
        langs, sources = pa.array([g[0] for g in found], pa.string()), pa.array([g[1] for g in found], pa.string())
        nothing = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(found), pa.string()), nothing, nothing], names)
        group = np.array([number[r[:2]] for r in rows])
        for term, own, n, docs in term_counts([r[2] for r in rows], group):
            own = pa.array(own)
            term = pa.array(term.tolist(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), term, pa.array(n), pa.array(docs)], names)

    rows, held = [], 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            if rows and held + len(text) > REGROUP:
                yield from flush(rows)
                rows, held = [], 0
            rows.append((lang, source, text))
            held += len(text)
    if rows:
        yield from flush(rows)


def _share(count: str, total: str, kinds: str) -> Column:
    """The smoothed share in billionths; null without kept terms."""
    return F.expr(f"1 + (cast({count} + 5 as decimal(20, 0)) * 1000000000 div nullif(cast({total} + 5 * {kinds} as decimal(20, 0)), 0))")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distances from rows (lang, i, j, part, term, at, p) in this order; rows with an empty term give the share of a count of 0.

    Gives (lang, a, b, value) for sources of block i and j, a before b, and (lang, i, j, number of terms) with ``terms`` set.
    """
    names = ["lang", "a", "b", "value", "terms"]
    key = left = right = sums = zero = None
    seen, rest = 0, None

    def add(term: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        nonlocal seen, sums
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]
        row = np.cumsum(new) - 1
        full = np.repeat(zero[None, :], int(new.sum()), axis=0)
        full[row, np.searchsorted(own, at)] = p
        seen += len(full)
        a, b = np.searchsorted(own, left), np.searchsorted(own, right)
        for k, column in enumerate(a):
            sums[k] += np.abs(full[:, b] - full[:, column : column + 1]).sum(axis=0)

    def close() -> Iterator[pa.RecordBatch]:
        if rest is not None:
            add(*rest)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        good = a < b
        n = int(good.sum()) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * n, pa.string()),
                pa.array(np.append(a[good], key[1])),
                pa.array(np.append(b[good], key[2])),
                pa.array(np.append(sums.ravel()[good], 0)),
                pa.array([None] * (n - 1) + [seen], pa.int64()),
            ],
            names,
        )

    own = np.zeros(0, dtype=np.int64)
    for batch in batches:
        lang, term = batch.column(0).to_pylist(), np.array(batch.column(4).to_pylist(), dtype=object)
        i, j, part, at, p = (batch.column(k).to_numpy() for k in (1, 2, 3, 5, 6))
        change = [0, *(k for k in range(1, len(lang)) if (lang[k], i[k], j[k], part[k]) != (lang[k - 1], i[k - 1], j[k - 1], part[k - 1])), len(lang)]
        for x, y in zip(change, change[1:]):
            now = (lang[x], int(i[x]), int(j[x]), int(part[x]))
            if now != key:
                if key is not None:
                    yield from close()
                key, rest, seen, sums = now, None, 0, None
                own, zero = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            head = x + int((term[x:y] == "").sum())
            if head > x:
                own, zero = np.append(own, at[x:head]), np.append(zero, p[x:head])
            if sums is None or head > x:
                left, right = own[own // BLOCK == now[1]], own[own // BLOCK == now[2]]
                sums = np.zeros((len(left), len(right)), dtype=np.int64)
            if head < y:
                some = [term[head:y], at[head:y], p[head:y]]
                if rest is not None:
                    some = [np.concatenate(z) for z in zip(rest, some)]
                # The last term may go on in the next batch.
                last = int(np.flatnonzero(some[0] != some[0][-1]).max(initial=-1)) + 1
                if last:
                    add(*(z[:last] for z in some))
                rest = [z[last:] for z in some]
    if key is not None:
        yield from close()


def _pairs(mine: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    blocks = groups.groupBy("lang").agg(F.floor(F.max("at") / BLOCK).alias("last"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Every row once for each block that its own block is compared with."""
        block = F.floor(F.col("at") / BLOCK)
        each = rows.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        return each.select("lang", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "part", "term", "at", "p")

    numbered = mine.join(groups.select("lang", "source", "at"), ["lang", "source"])
    counted = numbered.select("lang", "at", F.pmod(F.xxhash64("term"), F.lit(SPLITS)).alias("part"), "term", "p")
    zeros = groups.filter("kinds > 0").select("lang", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPLITS - 1).cast("bigint"))).alias("part"), F.lit("").alias("term"), F.col("zero").alias("p"))
    rows = dealt(counted.select("lang", "part", "term", "at", "p")).unionByName(dealt(zeros.select("lang", "part", "term", "at", "p")))
    rows = rows.repartition("lang", "i", "j", "part").sortWithinPartitions("lang", "i", "j", "part", "term", "at")
    sums = rows.mapInArrow(_distances, "lang string, a bigint, b bigint, value bigint, terms bigint")
    sums = stored(sums.groupBy("lang", "a", "b", F.col("terms").isNotNull().alias("whole")).agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")), "distances")
    far = sums.filter("not whole").select("lang", "a", "b", "value")
    far = far.union(far.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    seen = sums.filter("whole").select("lang", F.col("a").alias("i"), F.col("b").alias("j"), "terms")
    a = groups.select("lang", "source", F.col("at").alias("a"), "kinds", F.col("zero").alias("zero_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("zero").alias("zero_b"))
    block_a, block_b = F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK)
    both = a.join(b, "lang").filter("a != b").withColumns({"i": F.least(block_a, block_b), "j": F.greatest(block_a, block_b)})
    both = both.join(far, ["lang", "a", "b"], "left").join(seen, ["lang", "i", "j"], "left")
    value = F.expr("case when kinds = 0 then 0 else coalesce(value, 0) + (kinds - coalesce(terms, 0)) * abs(zero_a - zero_b) end")
    return both.select("lang", "source", "item", value.cast("bigint").alias("value"))


def source_divergence(docs: DataFrame, least: int = 30, top: int | None = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: distances to the other sources (``pair``) and the terms that a source
    uses more than its language, the first ``top`` of them (``term``; None is all)."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = plain.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counts = stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.filter("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "total"), "kept-terms")
    mine = stored(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_total"))
    own = mine.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(groups.withColumns({"at": place.cast("bigint"), "zero": _share("0", "own_total", "kinds")}), "groups")
    mine = mine.join(groups.select("lang", "source", "kinds", "lang_total", "own_total"), ["lang", "source"])
    mine = mine.withColumns({"p": _share("n", "own_total", "kinds"), "q": _share("total", "lang_total", "kinds")})
    # The distances are aggregates over small integers in tasks; batches of rows need no bytes bound here.
    pairs = _pairs(mine.select("lang", "source", "term", "p"), groups)
    more = mine.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
        out = rows.withColumn("rank", F.row_number().over(order))
        out = out.filter(F.col("rank") <= most) if most else out
        return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair", None).unionByName(ranked(more, "term", top))
