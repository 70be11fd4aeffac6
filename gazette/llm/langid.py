"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the product of its letters'
vectors, each rotated by its place; a text is the sum (bundle) of its trigrams' vectors, and a language prototype
the sum of its training texts, each scaled by its number of trigrams. A text gets the language whose prototype has the
largest cosine with it. The mean of all prototypes, which holds what the languages share, is taken off first.

Vectors have ``DIMENSIONS`` numbers, whatever the input. Prototypes are summed by Spark; only one vector per language
reaches the driver, and more than ``MOST_LANGUAGES`` languages are refused with an error.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts without a letter teach nothing;
equal cosines go to the language first by code point; without any language learned all texts are ``und``; a long
text is worked on alone; repeated rows and null identifiers need no rule; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, chunks
from gazette.llm.wordhash import mix

DIMENSIONS = 1024
MOST_LANGUAGES = 8192
CHUNK = 1 << 20
TEXTS = 256
KINDS = 1 << 13
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Vectors of +1 and -1 for code points; the same in every task."""
    words = DIMENSIONS // 64
    keys = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(77)
    bits = np.unpackbits(mix(mix(keys)).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the number of each value among them."""
    if top > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, dtype=bool)
    seen[values] = True
    number = np.cumsum(seen, dtype=np.int64) - 1
    return np.flatnonzero(seen), number[values]


def trigrams(values: list[str | None]) -> tuple[np.ndarray, np.ndarray, int, Callable[[int, int], np.ndarray]]:
    """Owner of each trigram of letters and spaces, its kind, the number of kinds, and a function for the vectors of a range of kinds.

    Whatever is no letter counts as a space; trigrams with two spaces in a row, or none but a space, are left out.
    """
    joined = " ".join([" ", *((v or "").lower() for v in values), " "])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_letters()[points], points, np.uint32(_SPACE)).astype(np.int64)
    size = np.array([len((v or "").lower()) + 1 for v in values], dtype=np.int64)
    owner = np.concatenate(([0, 0], np.repeat(np.arange(len(values)), size), [len(values) - 1] if values else []))[: len(points)]
    own, code = _numbered(points, 0x110000)
    a, b, c = code[:-2], code[1:-1], code[2:]
    blank = int(np.searchsorted(own, _SPACE))
    good = ~((a == blank) & (b == blank)) & ~((b == blank) & (c == blank)) & (b != blank)
    k = len(own)
    kinds, kind = _numbered((a[good] * k + b[good]) * k + c[good], k**3)
    vectors = letter_vectors(own)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)

    def bound(start: int, end: int) -> np.ndarray:
        some = kinds[start:end]
        return first[some // (k * k)] * second[some // k % k] * vectors[some % k]

    return owner[1:-1][good], kind, len(kinds), bound


def bundles(values: list[str | None], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vector of each text and its number of trigrams; with ``groups``, of each group of texts.

    In a group each text counts by 1 over its number of trigrams.
    """
    owner, kind, kinds, bound = trigrams(values)
    n = np.bincount(owner, minlength=len(values))
    rows, weights = len(values), None
    if groups is not None:
        rows, weights = int(groups.max()) + 1, 1.0 / n[owner]
        owner = groups[owner]
    # The matrices of counts and vectors are made for KINDS kinds at a time, however many different ones a long text has.
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    weights = weights[order] if weights is not None else None
    total = np.zeros((rows, DIMENSIONS))
    for start in range(0, kinds, KINDS):
        end = min(kinds, start + KINDS)
        a, b = np.searchsorted(kind, (start, end))
        width = end - start
        counts = np.bincount(owner[a:b] * width + kind[a:b] - start, weights=weights[a:b] if weights is not None else None, minlength=rows * width)
        total += counts.astype(np.float32).reshape(rows, width) @ bound(start, end).astype(np.float32)
    return total, n


def _groups(values: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose vectors are made together: few enough to keep the matrix of counts small."""
    for a, b in chunks(values, CHUNK):
        for i in range(a, b, TEXTS):
            yield i, min(b, i + TEXTS)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _groups(texts):
            names = sorted(set(langs[a:b]))
            vectors, _ = bundles(texts[a:b], np.array([names.index(x) for x in langs[a:b]]))
            for lang, vector in zip(names, vectors):
                total[lang] = total.get(lang, 0) + vector
        if len(total) > 64:
            yield from _sums(total)
            total = {}
    yield from _sums(total)


def _sums(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, vector in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "at", "part"]
        )


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their vectors, of length 1, learned from text and lang of all rows of ``docs``."""
    bounded_batches(docs.sparkSession)
    parts = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(_learn, "lang string, at int, part double")
    sums = parts.groupBy("lang", "at").agg(F.sum("part").alias("part"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "part")))["part"].alias("vector"))
    rows = sorted((r.lang, r.vector) for r in vectors.limit(MOST_LANGUAGES + 1).collect())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    matrix = np.array([v for _, v in rows]).reshape(len(rows), DIMENSIONS)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return [lang for lang, _ in rows], matrix


def identify(values: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the cosine, from 0 to 1."""
    vectors, n = bundles(values)
    has = (n > 0) & (len(langs) > 0)
    if not len(langs):
        return ["und"] * len(values), np.zeros(len(values))
    middle = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    own = matrix - middle
    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) - middle
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    cosine = np.round(vectors @ own.T, 9)
    best = cosine.argmax(axis=1)
    score = np.where(has, np.clip(cosine[np.arange(len(values)), best], 0, 1), 0.0)
    return [langs[i] if h else "und" for i, h in zip(best.tolist(), has.tolist())], np.round(score, 6)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the boolean columns ``also``."""
    also = also or {}
    names = list(also)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in _groups(values):
                pred, score = identify(values[a:b], langs, matrix)
                arrays = [batch.column(0).slice(a, b - a), *(batch.column(2 + i).slice(a, b - a) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score)], ["doc_id", *names, "lang_pred", "score"])

    schema = "doc_id bigint, " + "".join(f"{k} boolean, " for k in also) + "lang_pred string, score double"
    return docs.select("doc_id", "text", *(c.alias(k) for k, c in also.items())).mapInArrow(run, schema)


def language_of(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Prediction for every row, learned from the rows whose identifier's CRC-32 leaves a remainder other than 0."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    langs, matrix = prototypes(docs.filter(~held_out))
    return predict(docs, langs, matrix, {"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")
