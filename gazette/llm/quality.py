"""Quality rules from repetition coverage.

Rolling hashes of several word n-gram lengths are compared inside each text with numpy, many texts at once. A
character is covered when its word lies in an n-gram that occurs twice or more in the text; a line is repeated when
it holds a word and equals an earlier line. A text fails when too large a part of its characters is covered at one
of the lengths, or lies in repeated lines.

Defined cases: a null or empty text has no words, zero counts, and fails for its length; rows never meet, so ties,
repeated rows and null identifiers need no rule; only doc_id and text are read; a long text is worked on alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazette.llm.common import bounded_batches, chunks, texts
from gazette.llm.wordhash import Words, mix, span_hashes

#: Largest part of a text's characters that n-grams of a length may cover, and that repeated lines may hold.
GRAM_LIMITS = {5: 0.40, 7: 0.36, 10: 0.32}
LINE_LIMIT = 0.30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, line_cover double, " + ", ".join(f"cover_{n} double" for n in GRAM_LIMITS)
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered_words(words: Words, n: int) -> np.ndarray:
    """Which words lie in an ``n``-word window found twice or more in their text."""
    size = len(words.hash)
    keys, inside = words.windows(n)
    if not len(keys):
        return np.zeros(size, dtype=bool)
    own = mix(keys + words.doc[: len(keys)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    at = at[repeated(own[at])]
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _repeated_lines(words: Words, n_docs: int, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the characters in words of such lines."""
    ends = np.flatnonzero(words.data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    per_word = np.searchsorted(ends, words.start)
    filled = np.unique(per_word)
    starts, ends = starts[filled], ends[filled]
    doc = np.searchsorted(words.text_end, starts, side="right")
    keys = mix(span_hashes(words.data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first] = False
    in_line = np.bincount(np.searchsorted(filled, per_word), weights=chars, minlength=len(filled))
    return np.bincount(doc[later], minlength=n_docs), np.bincount(doc[later], weights=in_line[later], minlength=n_docs)


def measure(values: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts and verdicts of some texts."""
    n_docs = len(values)
    words = Words(values)
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    chars = points[words.end] - points[words.start]
    count = lambda weights=None: np.bincount(words.doc, weights=weights, minlength=n_docs)
    n_words, word_chars = count(), count(chars)
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))
    begins = np.concatenate(([0], words.text_end[:-1]))
    lines, line_chars = _repeated_lines(words, n_docs, chars)
    repeat = count(covered_words(words, 3))
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    share = np.maximum(word_chars, 1)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": marks[words.text_end] - marks[begins],
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
    }
    out = {k: v.astype(np.int64) for k, v in out.items()}
    cover = {"line_cover": line_chars / share}
    good = ~failed & (cover["line_cover"] <= LINE_LIMIT)
    for n, most in GRAM_LIMITS.items():
        cover[f"cover_{n}"] = count(chars * covered_words(words, n)) / share
        good &= cover[f"cover_{n}"] <= most
    return out | {"base_failed": failed, "kept": good} | cover


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = texts(batch.column(1))
        for a, b in chunks(values):
            found = measure(values[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, found.values())], ["doc_id", *found])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Counts, coverage and verdict of every row of ``docs``; no row leaves its task."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)
