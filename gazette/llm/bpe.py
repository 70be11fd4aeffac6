"""Byte-level BPE encoding and decoding with numpy.

Each match of the split pattern is merged by itself. The distinct matches of a chunk of texts are put into padded
matrices by length; in every round each row merges its leftmost pair of smallest rank, found through a hashed pair
table, and rows are compacted. Matches longer than ``MATRIX_BYTES`` follow the same rule with a heap, since a
matrix would take time with the square of their length.

Defined cases: null and empty texts have no tokens; any UTF-8 text decodes to itself; rows never meet, so ties,
repeated rows and null identifiers need no rule; a very long text is worked on alone; other columns pass unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gazette.llm.common import bounded_batches, chunks
from gazette.llm.wordhash import span_hashes

MATRIX_BYTES = 256
CACHED_WORDS = 200_000
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of byte strings, and the table of pairs that merge."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.size = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        by_id = [b""] * self.size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.by_id = by_id
        self.token_end = np.cumsum([len(t) for t in by_id])
        self.token_size = np.array([len(t) for t in by_id], dtype=np.int64)
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        hashes = span_hashes(self.token_bytes, self.token_end - self.token_size, self.token_end)
        order = np.argsort(hashes)
        self.known_hashes, self.known_ids = hashes[order], order.astype(np.uint32)
        keys, values = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        self._build(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear steps; ``longest`` bounds the steps of a look-up."""
        self.bits = max(8, int(4 * len(keys)).bit_length())
        room = 1 << self.bits
        self.keys, self.values = np.full(room, -1, dtype=np.int64), np.full(room, _NONE, dtype=np.int32)
        slot, left, self.longest = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = np.where(self.keys[slot[free]] == keys[free], values[free], self.values[slot[free]])
            left = left[self.keys[slot[left]] != keys[left]]
            placed = np.flatnonzero(self.keys[slot] == keys)
            self.values[slot[placed]] = values[placed]
            slot[left] = (slot[left] + 1) & (room - 1)
            self.longest += 1

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; a large number where none merges (or a side is padding, below zero)."""
        keys = a.astype(np.int64) * self.size + b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(a < 0) | (b < 0)] = _NONE
        return out


@lru_cache(maxsize=2)
def vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(ranks_file)


def _flat(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of ``n`` words in order, from groups of (word numbers, sizes, ids one after the other)."""
    size = np.zeros(n, dtype=np.int64)
    for rows, sizes, _ in groups:
        size[rows] = sizes
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if n else 0, dtype=np.uint32)
    for rows, sizes, ids in groups:
        out[_places(end[rows] - sizes, sizes)] = ids
    return size, out


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ``size[i]`` places from ``start[i]`` on, for all i one after the other."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


def merge_matrix(vocab: Vocabulary, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merge the rows of a matrix of byte ids (-1 is padding); groups for ``_flat``."""
    n, width = ids.shape
    groups, rows = [], np.arange(n)
    ranks = vocab.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        m, w = ids.shape
        if w > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(m), at]
            go = best != _NONE
        else:
            go = np.zeros(m, dtype=bool)
        if not go.all():
            done = ids[~go]
            inside = done >= 0
            groups.append((rows[~go], inside.sum(axis=1), done[inside]))
            rows, ids, ranks = rows[go], ids[go], ranks[go]
            if not len(rows):
                break
            at, best, m = at[go], best[go], len(rows)
        line = np.arange(m)
        ids[line, at] = best
        keep = np.ones((m, w), dtype=bool)
        keep[line, at + 1] = False
        ids = ids[keep].reshape(m, w - 1)
        keep_rank = np.ones((m, w - 1), dtype=bool)
        keep_rank[line, at] = False
        ranks = ranks[keep_rank].reshape(m, w - 2)
        if w > 2:
            # The pairs at the left and the right of the merged place are new.
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = vocab.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < w - 2)
            ranks[right, at[right]] = vocab.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
    return groups


def merge_long(vocab: Vocabulary, word: bytes) -> np.ndarray:
    """Ids of one long word: the same rule with a heap of pairs and linked neighbours."""
    ranks, part = vocab.ranks.get, [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return np.array([vocab.ranks[p] for p in part if p is not None], dtype=np.uint32)


def encode_spans(vocab: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of distinct words, given as spans of ``data``; words are worked on by length."""
    size, groups = end - start, []
    # A word that is itself in the vocabulary is one token.
    at = np.minimum(np.searchsorted(vocab.known_hashes, hashes), len(vocab.known_hashes) - 1)
    whole = vocab.known_hashes[at] == hashes
    groups.append((np.flatnonzero(whole), np.ones(int(whole.sum()), dtype=np.int64), vocab.known_ids[at[whole]]))
    width = np.where(size <= 32, -(-size // 4) * 4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for w in np.unique(width[~whole & (size <= MATRIX_BYTES)]).tolist():
        rows = np.flatnonzero(~whole & (width == w) & (size <= MATRIX_BYTES))
        step = max(1, (1 << 18) // w)
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            inside = np.arange(w) < size[some, None]
            ids = np.full((len(some), w), -1, dtype=np.int32)
            ids[inside] = vocab.byte_id[data[_places(start[some], size[some])]]
            groups += [(some[r], k, x) for r, k, x in merge_matrix(vocab, ids)]
    for r in np.flatnonzero(~whole & (size > MATRIX_BYTES)).tolist():
        ids = merge_long(vocab, data[start[r] : end[r]].tobytes())
        groups.append((np.array([r]), np.array([len(ids)]), ids))
    return _flat(groups, len(size))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 white space, 3 anything else."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.frombuffer(every.encode("utf-32-le"), dtype=np.uint32)
    out = np.full(0x110000, 3, dtype=np.uint8)
    for kind, name in enumerate((r"\p{L}", r"\p{N}", r"\s")):
        spans = np.array([m.span() for m in regex.finditer(name + "+", every)])
        out[points[_places(spans[:, 0], spans[:, 1] - spans[:, 0])]] = kind
    return out


#: The split pattern that ``split_points`` does with arrays; any other goes through the regex library.
ARRAY_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_points(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where the matches of ``ARRAY_PATTERN`` start in texts that stand one after the other as code points.

    A match is a run of one class; a space before a run of letters, numbers or others belongs to it, the white space
    before that is a match of its own, and an apostrophe with one of the endings is a match too.
    """
    n = len(points)
    kind = _classes()[points]
    is_text = np.zeros(n + 1, dtype=bool)
    is_text[text_start] = True
    is_text[n] = True
    run = is_text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[0] = True
    out = run.copy()
    # Runs after white space in the same text: the last white character before them.
    after = np.flatnonzero(run[1:n] & ~is_text[1:n] & (kind[:-1] == 2)) + 1
    out[after - 1] = True
    out[after[points[after - 1] == 32]] = False
    marks = np.flatnonzero((points == 39) & out[:n] & run[:n])
    marks = marks[is_text[marks] | (kind[marks - 1] != 3)]
    padded = np.concatenate((points, np.zeros(3, dtype=points.dtype)))
    within = np.concatenate((np.cumsum(is_text[:n]), np.full(3, -1)))
    for ending in _ENDINGS:
        hit = np.ones(len(marks), dtype=bool)
        for i, letter in enumerate(ending, 1):
            hit &= (padded[marks + i] == ord(letter)) & (within[marks + i] == within[marks])
        found = marks[hit]
        out[found + 1] = False
        out[found + 1 + len(ending)] = True
    return np.flatnonzero(out[:n])


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of a sequence of ids."""
    at = ids.astype(np.int64)
    size = vocab.token_size[at]
    return vocab.token_bytes[_places(vocab.token_end[at] - size, size)].tobytes()


def _spans(values: list[str], pattern: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes of some texts, where each match starts and ends, and the first match of each text (and the end)."""
    joined = "".join(values)
    data = joined.encode("utf-8")
    if pattern == ARRAY_PATTERN:
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        text = np.cumsum([0, *map(len, values)])
        start = split_points(points, text[:-1][np.diff(text) > 0]) if len(points) else np.zeros(0, dtype=np.int64)
        if len(data) != len(points):
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            place = np.concatenate(([0], np.cumsum(size)))
            start, text = place[start], place[text]
    else:
        match = regex.compile(pattern)
        text = np.cumsum([0, *(len(v.encode("utf-8")) for v in values)])
        sizes = [[len(w.encode("utf-8")) for w in match.findall(v)] for v in values]
        start = np.cumsum([0, *(s for x in sizes for s in x)], dtype=np.int64)[:-1]
    return data, np.append(start, len(data)), np.searchsorted(start, text)


def encoder(ranks_file: bytes, pattern: str):
    """A function from texts to their ids and decoded bytes, that remembers words up to a bound."""
    vocab = vocabulary(ranks_file)
    known = [np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)]

    def ids_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, remember: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of all spans: each distinct word is merged once."""
        hashes, one, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
        old = (known[0][at] == hashes) & remember
        fresh = one[~old]
        size, ids = encode_spans(vocab, data, start[fresh], end[fresh], hashes[~old])
        old_size = known[2][at[old]]
        old_ids = known[3][_places(known[1][at[old]], old_size)]
        sizes, flat = _flat([(np.flatnonzero(~old), size, ids), (np.flatnonzero(old), old_size, old_ids)], len(hashes))
        begin = np.cumsum(sizes) - sizes
        if remember and len(fresh):
            if len(known[0]) + len(fresh) <= CACHED_WORDS:
                order = np.argsort(both := np.concatenate((known[0], hashes[~old])), kind="stable")
                starts = np.concatenate((known[1], len(known[3]) + np.cumsum(size) - size))
                known[:] = both[order], starts[order], np.concatenate((known[2], size))[order], np.concatenate((known[3], ids))
            else:
                known[:] = hashes, begin, sizes, flat
        return sizes[inverse], flat[_places(begin[inverse], sizes[inverse])]

    def encode(values: list[str | None]) -> list[tuple[np.ndarray, bytes]]:
        values = [v or "" for v in values]
        data, edge, first = _spans(values, pattern)
        if not data:
            return [(np.zeros(0, dtype=np.uint32), b"")] * len(values)
        array = np.frombuffer(data, dtype=np.uint8)
        for remember in (True, False):
            sizes, ids = ids_of(array, edge[:-1], edge[1:], remember)
            decoded = decode_ids(vocab, ids)
            if decoded == data:
                break
            # Two words with one hash: try again with the words of this chunk alone.
        else:
            raise ValueError("the vocabulary does not give back the text")
        place = np.concatenate(([0], np.cumsum(sizes)))[first]
        return [(ids[a:b], decode_ids(vocab, ids[a:b])) for a, b in zip(place[:-1].tolist(), place[1:].tolist())]

    return encode


def encode_decode(docs: DataFrame, ranks_file: bytes, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with ``ids``, also the ids (little-endian)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file, pattern)
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in chunks(values):
                found = encode(values[a:b])
                raw = [x.astype("<u4").tobytes() for x, _ in found]
                arrays = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for _, x in found], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays, names = [*arrays, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
