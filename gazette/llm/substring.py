"""Substring duplicates by level-wise doubling.

A word is removed when a window of ``window`` words around it also starts in a document with a smaller identifier.
Levels have ``start`` words, then twice as many each time, up to ``window``. At each level every window still alive
stands for the words around its anchor; only those repeated in another document go on to the next length. The
doubling ends at the wanted length, or before it when no candidate survives.

The anchor of a window is the place in it whose ``start`` words have the smallest hash, so equal windows have equal
anchors, and neighbours share theirs: at the first level about a quarter of all places are shuffled. Words that are
repeated within one chunk of texts are known to be so without a shuffle, and send one row for all of them; a passage
that very many documents share thus costs a row per chunk. Each level is written to the shared folder.

Words are compared by 64-bit hashes at each level; with n windows that reach the last level, the number of windows
taken for equal wrongly is expected to stay under n * n / 2**65.

Defined cases: null and empty texts have no words; a null doc_id comes after all others, and such rows are not
compared with each other; rows with the same doc_id are not compared with each other either, whatever their texts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, chunks, stored, texts
from gazette.llm.wordhash import Words, mix

_LAST = np.iinfo(np.int64).max


def levels(window: int, start: int) -> list[int]:
    """Lengths from ``start``, doubled, up to ``window``."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _anchors(words: Words, window: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of every window."""
    size = len(words.hash) - window + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes, _ = words.windows(start, seed=start)
    best, at = hashes[:size].copy(), np.zeros(size, dtype=np.int64)
    for k in range(1, window - start + 1):
        less = hashes[k : k + size] < best
        best[less] = hashes[k : k + size][less]
        at[less] = k
    first = np.flatnonzero(words.doc[:size] == words.doc[window - 1 :])
    return first, first + at[first]


def _spans(first: np.ndarray, anchor: np.ndarray, window: int, length: int) -> np.ndarray:
    """Where the ``length`` words that stand for a window begin: around its anchor, inside it."""
    return np.maximum(first, np.minimum(anchor, first + window - length))


def _joined(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), dtype="<i4")


def _alive(words: Words, window: int, start: int, length: int, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose words at the level of ``length`` begin at one of the given places of their text."""
    first, anchor = _anchors(words, window, start)
    marked = np.zeros(len(words.hash) + 1, dtype=bool)
    for i, own in enumerate(places):
        if len(own):
            marked[words.first[i] + own] = True
    good = marked[_spans(first, anchor, window, length)]
    return first[good], anchor[good]


def _level(window: int, start: int, length: int, before: int | None, last: bool):
    """Rows (hash, doc_id, tag, places, sure) of one level; places are 32-bit numbers one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = texts(batch.column(1)), batch.column(0).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
            for a, b in chunks(values):
                words = Words(values[a:b])
                if before is None:
                    first, anchor = _anchors(words, window, start)
                else:
                    lists = batch.column(2).slice(a, b - a)
                    first, anchor = _alive(words, window, start, before, [_joined(x) for x in lists.to_pylist()])
                place = np.unique(_spans(first, anchor, window, length))
                if not len(place):
                    continue
                hashes, _ = words.windows(length, seed=length)
                key, doc = hashes[place], ids[a:b][words.doc[place]]
                # Within the chunk: one row for a hash and a text, smallest identifier first.
                owner = words.doc[place]
                order = np.lexsort((place, owner, doc, key))
                k, d, o = key[order], doc[order], owner[order]
                new = np.concatenate(([True], k[1:] != k[:-1]))
                pair = np.flatnonzero(new | np.concatenate(([True], o[1:] != o[:-1])))
                within = (place - words.first[owner])[order].astype("<i4")
                group = np.cumsum(new) - 1
                low = d[new][group]
                if last:
                    sure = d != low
                else:
                    many = np.zeros(group[-1] + 1, dtype=bool)
                    many[group[d != low]] = True
                    sure = many[group]
                # The first row keeps the hash; others that are known to be repeated may go anywhere.
                spread = sure & ~new
                send = np.where(spread, mix(mix(d.astype(np.uint64)) + within.astype(np.uint64)), k).view(np.int64)
                tags = np.array([zlib.crc32(v or b"") for v in values[a:b]], dtype=np.int64)
                edge = np.append(pair, len(order)).astype(np.int32) * 4
                joined = pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer(edge), pa.py_buffer(within.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(send[pair]), pa.array(d[pair]), pa.array(tags[o[pair]]), joined, pa.array(sure[pair])],
                    ["hash", "doc_id", "tag", "places", "sure"],
                )

    return run


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(int(_LAST)))


def _with_places(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """doc_id, text and the places found in it; rows of equal identifier and text have equal lists, which count once, so
    the distinct ones are bounded by the text itself."""
    places = found.groupBy(F.col("doc_id").alias("own"), F.col("tag").alias("mark")).agg(F.collect_set("places").alias("places"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", "text", _id().alias("id"), F.crc32(F.encode(text, "UTF-8")).alias("sum"))
    return keyed.join(places, (keyed.id == places.own) & (keyed.sum == places.mark), how).select("doc_id", "text", "places")


def repeated_places(docs: DataFrame, window: int = 13, start: int = 7) -> DataFrame:
    """doc_id, tag (of the text) and places of every window that also starts in a document with a smaller doc_id."""
    bounded_batches(docs.sparkSession)
    found, before = None, None
    lengths = levels(window, start)
    for length in lengths:
        last = length == lengths[-1]
        source = docs.select("doc_id", "text") if found is None else _with_places(docs, found, "inner")
        rows = source.mapInArrow(_level(window, lengths[0], length, before, last), "hash bigint, doc_id bigint, tag bigint, places binary, sure boolean")
        same = Window.partitionBy("hash")
        rows = rows.withColumn("low", F.min("doc_id").over(same))
        if last:
            rows = rows.filter(F.col("sure") | (F.col("doc_id") > F.col("low")))
        else:
            rows = rows.withColumn("high", F.max("doc_id").over(same)).filter(F.col("sure") | (F.col("low") < F.col("high")))
        found, before = stored(rows.select("doc_id", "tag", "places"), f"repeated-{length}"), length
        if found.isEmpty():
            break
    return found


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, sums, kept = [], [], [], []
            for value, places in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                words = (value or b"").split()
                n = len(words)
                if places:
                    steps = np.zeros(n + 1, dtype=np.int32)
                    at = np.unique(_joined(places))
                    steps[at] += 1
                    steps[at + window] -= 1
                    words = list(compress(words, (np.cumsum(steps[:-1]) == 0).tolist()))
                joined = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                sums.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeated(docs: DataFrame, window: int = 13, start: int = 7, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with ``with_text``, also the words that stay."""
    found = repeated_places(docs, window, start)
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return _with_places(docs, found, "left").mapInArrow(_kept(window, with_text), schema)
