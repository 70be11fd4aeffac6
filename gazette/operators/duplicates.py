"""Exact and near duplicates by title and URL.

Near duplicates are found among the distinct texts of one authority, so a group of copies of any size counts as one
text. No step loses a pair.

Bounds. With ``M`` characters in matching blocks the ratio is ``2M / (a + b)``. ``M`` cannot exceed the shorter length, nor
the overlap of the two bags of characters. Between two blocks lies a character without a match, so there are at most
``a + b - 2M + 1`` blocks, and the texts share at least ``3M - a - b - 1`` bigrams. Counts over groups of characters, or of
bigrams, are never below the overlap, so they bound it as well. Matching blocks are a common subsequence, so ``M`` cannot
exceed the longest one, which is far quicker to find, for many pairs at once.

Blocks. Similar texts are close in length: they lie in one of ``BANDS`` + 1 neighbouring bands of lengths. The texts of a band
are dealt into blocks of about ``BLOCK`` rows, and each two blocks of neighbouring bands are a key of their own, whose counts
are compared as matrices of small numbers. So a host of any size is many keys of a bounded size, and only what passes all
bounds is compared as text. The comparisons grow with the square of the texts of one host, as their pairs do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructType

from ..functions.text import col, normalise_title, text_or_empty
from ..functions.urls import split_url
from ..session import shared_folder

#: Rows and characters of a block, rows of one title that meet in a key, and bands up to the least length of a similar text.
BLOCK = 4096
CHARACTERS = 1 << 21
MEMBERS = 512
BANDS = 2
#: Longest text whose common subsequences are found first; of two texts the shorter one counts.
LONG = 4096
#: Characters of two texts together up to which their ratio is kept by pattern.
SHORT = 64
#: Words of places and rows of words that are looked up at once, for longest common subsequences.
TABLE, WORDS = 1 << 21, 1 << 14
#: Rows whose counts are compared with a block at once, and pairs whose bigrams are.
TILE, COLUMNS = 128, 2048
_KNOWN = 1 << 16

# Characters with a count of their own; all others share the rest of the counts.
_COMMON = "eatoinsrlhducmpgfy-/ wbvkxjqz0123456789._"
_GROUPS, _BIGRAM_GROUPS = 64, 512
_SMALL = 1e-9


def _places(text: str) -> dict[str, int]:
    """The places of each character of a text as the bits of a number."""
    places = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def _common_subsequence(places: dict[str, int], n: int, text: str, least: int = 0) -> int:
    """Length of the longest common subsequence of a text and one of ``n`` characters, a row of the table as one number.

    -1 as soon as it cannot be ``least`` any more.
    """
    full = (1 << n) - 1
    row = full
    for k in range(0, len(text), 64):
        for c in text[k : k + 64]:
            here = row & places.get(c, 0)
            row = ((row + here) | (row - here)) & full
        rest = max(len(text) - k - 64, 0)
        place = max(n - rest, 0)
        if place - (row & ((1 << place) - 1)).bit_count() + min(rest, n) < least:
            return -1
    return n - row.bit_count()


class _Texts:
    """Texts and the codes of their characters one after another."""

    def __init__(self, texts: list[str]):
        self.texts, self.n = texts, np.array([len(t) for t in texts], dtype=np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.n)))[:-1]


class _Common:
    """Longest common subsequences of many pairs of texts of two blocks, a bit of a word for each place of the left text.

    After some characters of the right text, the first places of the left one have met them in a known length. What is left
    of both texts can add its own length at most, so most pairs are left off halfway.
    """

    def __init__(self, left: _Texts, right: _Texts):
        self.left, self.right = left, right
        letters = np.unique(left.codes)
        number = np.zeros(0x110000, dtype=np.int32)
        number[letters] = np.arange(1, len(letters) + 1)
        # 0 is a character that no left text has.
        self.own, self.other, self.size = number[left.codes], number[right.codes], len(letters) + 1

    def __call__(self, u: np.ndarray, v: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The lengths, or -1 where they are less than ``least``, for some."""
        out = np.empty(len(u), dtype=np.int64)
        words = int(self.left.n[u].max(initial=0)) // 64 + 1
        if len(u) < 32 + 16 * words:
            places = {}
            for k, (i, j) in enumerate(zip(u.tolist(), v.tolist())):
                if i not in places:
                    places = {i: _places(self.left.texts[i])}
                out[k] = _common_subsequence(places[i], int(self.left.n[i]), self.right.texts[j], int(least[k]))
            return out
        order = np.argsort(u, kind="stable")
        rows, first = np.unique(u[order], return_index=True)
        first = np.append(first, len(u))
        step, most = max(1, TABLE // (words * self.size)), max(256, WORDS // words)
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            table = self._table(some, words)
            for x in range(first[k], first[k + len(some)], most):
                at = order[x : min(x + most, first[k + len(some)])]
                out[at] = self._lengths(table, np.searchsorted(some, u[at]) * self.size, self.left.n[u[at]], v[at], least[at])
        return out

    def _table(self, rows: np.ndarray, words: int) -> np.ndarray:
        """For each word, row and character the places of the character as bits."""
        table = np.zeros((words, len(rows) * self.size), dtype=np.uint64)
        n, heads, base = self.left.n[rows], self.left.first[rows], np.arange(len(rows)) * self.size
        for i in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > i)
            table[i >> 6, base[on] + self.own[heads[on] + i]] |= np.uint64(1 << (i & 63))
        return table

    def _lengths(self, table: np.ndarray, base: np.ndarray, n: np.ndarray, v: np.ndarray, least: np.ndarray) -> np.ndarray:
        # The longest right texts first, so that those which have a next character are the first ones.
        live = np.argsort(-self.right.n[v], kind="stable")
        base, n, least, m, heads = base[live], n[live], least[live], self.right.n[v][live], self.right.first[v][live]
        out = np.full(len(v), -1, dtype=np.int64)
        row = np.full((len(table), len(v)), ~np.uint64(0))
        for j in range(int(m.max(initial=0))):
            if j and j % 16 == 0:
                on = np.flatnonzero(self._most(row, n, m, j) >= least)
                if len(on) < 0.8 * len(live):
                    live, base, n, least, m, heads, row = live[on], base[on], n[on], least[on], m[on], heads[on], row[:, on]
            k = int(np.searchsorted(-m, -j))
            if not k:
                break
            letter = base[:k] + self.other[heads[:k] + j]
            carry = None
            for word, places in zip(row, table):
                have = word[:k]
                here = places[letter]
                here &= have
                total = have + here
                if len(table) > 1:
                    over = total < have
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over
                have -= here
                have |= total
        out[live] = self._most(row, n, m, len(self.right.codes))
        return out

    @staticmethod
    def _most(row: np.ndarray, n: np.ndarray, m: np.ndarray, j: int) -> np.ndarray:
        """The most that the lengths can be after ``j`` characters of the right texts; at their ends the lengths themselves."""
        rest = np.maximum(m - j, 0)
        place = np.maximum(n - rest, 0)
        length = np.minimum(rest, n)
        for w, word in enumerate(row):
            bits = np.clip(place - 64 * w, 0, 64)
            before = np.where(bits < 64, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            length = length + np.bitwise_count(~word & before)
        return length


def _short_common(left: _Texts, right: _Texts, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same lengths, whatever they are."""
    return _Common(left, right)(u, v, np.zeros(len(u), dtype=np.int64))


def _least(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """The least number of characters in matching blocks of two texts with these lengths together."""
    return np.ceil((threshold * lengths - _SMALL) / 2).astype(np.int64)


def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


class _Ratios:
    """Ratios of short texts by the pattern of their equal characters, on which alone the ratio depends."""

    def __init__(self):
        self.known = {}

    def __call__(self, left: str, right: str) -> float:
        if len(left) + len(right) > SHORT:
            return _ratio(left, right)
        number = {}
        pattern = (len(left), bytes([number.setdefault(c, len(number)) for c in left + right]))
        ratio = self.known.get(pattern)
        if ratio is None:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            ratio = self.known[pattern] = _ratio(left, right)
        return ratio


@cache
def _kept_ratios() -> _Ratios:
    """The ratios that the tasks of a process have found."""
    return _Ratios()


@pandas_udf(DoubleType())
def matching_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of two texts, in this order; 1 for two empty ones. Repeated pairs are compared once."""
    known = {}
    for left, right in batches:
        ratios = []
        for pair in zip(left, right):
            if pair not in known:
                if len(known) >= _KNOWN:
                    known.clear()
                known[pair] = _ratio(*pair)
            ratios.append(known[pair])
        yield pd.Series(ratios, index=left.index, dtype="float64")


def _with_similar_paths(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the rows whose ``left_path`` and ``right_path`` are equal or reach the threshold, with their ratio
    as ``path_ratio`` in place of the paths.

    The pairs of a batch whose longest common subsequence is too short are left out many at a time. Rows go through Python
    whole, as Spark would keep them on disk to join them with a column of ratios.
    """

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, compare = {}, _kept_ratios()
        for batch in batches:
            left, right = batch.column("left_path").to_pylist(), batch.column("right_path").to_pylist()
            numbers, names = pd.factorize(np.array(left + right, dtype=object))
            texts = _Texts(names.tolist())
            pairs, place = np.unique(numbers[: len(left)] * len(names) + numbers[len(left) :], return_inverse=True)
            u, v = np.divmod(pairs, max(len(names), 1))
            n, m = texts.n[u], texts.n[v]
            least = _least(n + m, threshold)
            some = np.flatnonzero((u != v) & (np.minimum(n, m) <= LONG))
            good = np.full(len(pairs), True)
            good[some] = _Common(texts, texts)(u[some], v[some], least[some]) >= least[some]
            ratios = np.full(len(pairs), np.nan)
            for k in np.flatnonzero(good).tolist():
                pair = names[u[k]], names[v[k]]
                if pair not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[pair] = compare(*pair)
                if u[k] == v[k] or known[pair] >= threshold:
                    ratios[k] = known[pair]
            ratios = ratios[place]
            rows = batch.drop_columns(["left_path", "right_path"]).append_column("path_ratio", pa.array(ratios))
            yield rows.filter(pa.array(~np.isnan(ratios)))

    return rated


class _Counts(_Texts):
    """Texts in the order of their lengths, with counts of their characters and bigrams by group."""

    def __init__(self, rows: np.ndarray, texts: list[str]):
        order = np.argsort(np.array([len(t) for t in texts], dtype=np.int64), kind="stable")
        super().__init__([texts[i] for i in order.tolist()])
        self.rows = rows[order]
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        own = np.full(128, -1, dtype=np.int64)
        own[[ord(c) for c in _COMMON]] = np.arange(len(_COMMON))
        groups = own[np.minimum(self.codes, 127)]
        others = len(_COMMON) + self.codes % (_GROUPS - len(_COMMON))
        self.characters = self._counted(self.owner, np.where((self.codes < 127) & (groups >= 0), groups, others), _GROUPS).T.copy()
        self._bigrams = None

    def _counted(self, owner: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Counts per text and group, in the smallest type that holds the longest text."""
        kind = np.min_scalar_type(int(self.n.max(initial=0)))
        out = np.empty((len(self.n), groups), dtype=kind)
        for a in range(0, len(self.n), 1024):
            b = min(a + 1024, len(self.n))
            x, y = np.searchsorted(owner, [a, b])
            out[a:b] = np.bincount((owner[x:y] - a) * groups + group[x:y].astype(np.int64), minlength=(b - a) * groups).reshape(b - a, groups)
        return out

    @property
    def bigrams(self) -> np.ndarray:
        if self._bigrams is None:
            inside = self.owner[1:] == self.owner[:-1]
            pair = (self.codes[:-1].astype(np.uint64) << np.uint64(21)) + self.codes[1:]
            pair = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
            self._bigrams = self._counted(self.owner[:-1][inside], pair[inside], _BIGRAM_GROUPS)
        return self._bigrams


def _candidates(left: _Counts, right: _Counts, threshold: float, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that the bounds do not rule out, each pair once; ``one`` block is both sides."""
    if not len(left.n) or not len(right.n):
        return
    totals = np.arange(int(left.n[-1] + right.n[-1]) + 1)
    need = np.ceil((threshold * totals - _SMALL) / 2).astype(np.int32)
    grams = np.ceil((1.5 * threshold - 1) * totals - 1 - _SMALL).astype(np.int64)
    share = threshold / (2 - threshold)
    groups = np.flatnonzero(left.characters.any(axis=1) & right.characters.any(axis=1))
    for a in range(0, len(left.n), TILE):
        n = left.n[a : a + TILE]
        x = max(int(np.searchsorted(right.n, math.ceil(n[0] * share - _SMALL))), a if one else 0)
        y = int(np.searchsorted(right.n, n[-1] / share + _SMALL if share else np.inf, side="right"))
        # Few enough columns at once for the counts to stay in the cache.
        for x in range(x, y, COLUMNS):
            z = min(x + COLUMNS, y)
            most = min(int(n[-1]), int(right.n[z - 1]))
            shared = np.zeros((len(n), z - x), dtype=np.min_scalar_type(most))
            for g in groups.tolist():
                shared += np.minimum(left.characters[g, a : a + TILE, None], right.characters[g, None, x:z]).astype(shared.dtype, copy=False)
            i, j = np.nonzero(shared >= need[n[:, None] + right.n[None, x:z]])
            i, j = i + a, j + x
            if one:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 4096):
                u, v = i[k : k + 4096], j[k : k + 4096]
                few = grams[left.n[u] + right.n[v]]
                good = few <= 0
                some = np.flatnonzero(~good)
                good[some] = np.minimum(left.bigrams[u[some]], right.bigrams[v[some]]).sum(axis=1, dtype=np.int64) >= few[some]
                yield u[good], v[good]


def _compared(threshold: float, both: bool) -> Callable[[pa.Table], pa.Table]:
    """The similar pairs of a key's rows (side, row, text): 0 is one block with itself, 1 and 2 are two blocks."""

    def pairs(table: pa.Table) -> pa.Table:
        compare = _kept_ratios()
        side, rows = table.column("side").to_numpy(), table.column("row").to_numpy()
        texts, within = table.column("text").to_pylist(), table.column("within")[0].as_py()
        one = bool((side == 0).any())
        parts = []
        for s in (0,) if one else (1, 2):
            at = np.flatnonzero(side == s)
            parts.append(_Counts(rows[at], [texts[i] for i in at.tolist()]))
        left, right = parts[0], parts[-1]
        found = []
        common = _Common(left, right)
        for u, v in _candidates(left, right, threshold, one):
            least = _least(left.n[u] + right.n[v], threshold)
            good = np.minimum(left.n[u], right.n[v]) > LONG
            some = np.flatnonzero(~good)
            good[some] = common(u[some], v[some], least[some]) >= least[some]
            for i, j in zip(u[good].tolist(), v[good].tolist()):
                a, b = (int(left.rows[i]), left.texts[i]), (int(right.rows[j]), right.texts[j])
                a, b = min(a, b), max(a, b)
                ratio = compare(a[1], b[1])
                back = compare(b[1], a[1]) if both else ratio
                if max(ratio, back) >= threshold:
                    found.append((within, a[0], b[0], ratio, back))
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["within", "a_row", "b_row", "ratio", "back"])

    return pairs


def with_duplicate_keys(articles: DataFrame) -> DataFrame:
    """Adds ``norm_title``, ``authority`` and ``path``."""
    parts = split_url("link")
    return articles.withColumns(
        {"norm_title": normalise_title("title"), "authority": parts.authority, "path": parts.path}
    )


def exact_duplicates(articles: DataFrame) -> DataFrame:
    """Groups of articles with equal normalised title, authority and path."""
    keyed = with_duplicate_keys(articles).groupBy("norm_title", "authority", "path")
    return keyed.agg(F.count(F.lit(1)).alias("copies"), F.min("link").alias("first_link")).where("copies > 1")


def _similar(rows: DataFrame, text: str, threshold: float, *, within: str, both: bool = False) -> DataFrame:
    """``within, a_row, b_row, ratio, back`` of the rows (``row``, ``within``, a text), different in their texts where
    equal in ``within``, whose texts reach the ratio, each pair once with the smaller row as ``a``.

    ``back`` is the ratio of ``b`` with ``a``; with ``both`` one of the two ratios is enough.
    """
    share = min(max(threshold / (2 - threshold), 1e-6), 0.99)
    # Similar lengths are at most BANDS apart; the factor is a little less, so that rounding cannot make it more.
    band = F.floor(F.log(F.length(text) + 1.0) * F.lit((BANDS - 1e-6) / -math.log(share))).cast("int")
    sized = rows.select("row", col(within).alias("within"), col(text).alias("text"), band.alias("band"))
    much = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("text")) / CHARACTERS)
    blocks = sized.groupBy("within", "band").agg(F.greatest(F.ceil(much), F.lit(1)).cast("int").alias("blocks"))
    other = blocks.select("within", col("band").alias("near"), col("blocks").alias("near_blocks"))
    # For each band what its rows meet: the bands around it, with the number of their blocks.
    met = blocks.join(other, "within").where(F.abs(col("near") - col("band")) <= BANDS)
    dealt = sized.join(met, ["within", "band"]).withColumn("block", F.pmod(F.xxhash64("row"), col("blocks")).cast("int"))
    dealt = dealt.withColumn("near_block", F.explode(F.sequence(F.lit(0), col("near_blocks") - 1)))
    here, there = F.struct(col("band").alias("band"), col("block").alias("block")), F.struct(col("near").alias("band"), col("near_block").alias("block"))
    key = ["within", "low", "high"]
    side = F.when(here == there, 0).when(here < there, 1).otherwise(2)
    dealt = dealt.select("within", F.least(here, there).alias("low"), F.greatest(here, there).alias("high"), side.alias("side"), "row", "text")
    # Keys are few and their work is in comparing, so they are dealt over many tasks and not put together by their bytes.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    schema = "within string, a_row bigint, b_row bigint, ratio double, back double"
    pairs = dealt.repartition(parts, *key).groupBy(*key).applyInArrow(_compared(threshold, both), schema)
    return pairs.withColumnRenamed("within", within)


def _numbered_rows(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a number. The written table fixes the numbers, is read several times, and outlives an executor."""
    spark = rows.sparkSession
    place = shared_folder(spark, label)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows.write.parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def _members(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of the rows (``row`` and a struct ``one``) of each two rows, or of one with itself; in the latter each two once.

    The rows of a number are dealt into blocks of about ``MEMBERS``, and each two blocks are a key.
    """
    blocks = rows.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    for side in ("a", "b"):
        numbered = blocks.select(col("row").alias(f"{side}_row"), F.explode(F.sequence(F.lit(0), col("blocks") - 1)).alias(f"{side}_block"))
        pairs = pairs.join(numbered, f"{side}_row")
    pairs = pairs.where("a_row != b_row or a_block <= b_block")
    dealt = rows.join(blocks, "row").withColumn("block", F.pmod(F.xxhash64("one"), col("blocks")).cast("int"))
    for side in ("a", "b"):
        pairs = pairs.join(dealt.select(col("row").alias(f"{side}_row"), col("block").alias(f"{side}_block"), col("one").alias(side)), [f"{side}_row", f"{side}_block"])
    return pairs.where("a_row != b_row or a_block != b_block or a < b")


def fuzzy_duplicates(articles: DataFrame, *, title_threshold: float = 0.85, url_threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct (title, authority, path) rows that are near duplicates.

    ``left_link`` and ``right_link`` are the smallest links of the two rows and ``left_copies``,
    ``right_copies`` the numbers of articles that share them; the ratios compare left with right, which is the
    row with the smaller link, on ties with the smaller title.
    """
    rows = with_duplicate_keys(articles).groupBy("norm_title", "authority", "path").agg(
        F.min("link").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    rows = _numbered_rows(rows.withColumnRenamed("norm_title", "title"), "titled").drop("row")
    # A title of an authority is compared once, however many paths it has.
    titles = rows.groupBy("authority", "title").agg(F.count(F.lit(1)).alias("paths"))
    titles = _numbered_rows(titles, "titles")
    members = rows.join(titles, ["authority", "title"]).select("row", F.struct("id", "title", "path", "copies").alias("one"))
    several = titles.where("paths > 1").withColumn("ratio", matching_ratio("title", "title"))
    pairs = _similar(titles.select("row", "authority", "title"), "title", title_threshold, within="authority", both=True)
    pairs = pairs.unionByName(several.select("authority", col("row").alias("a_row"), col("row").alias("b_row"), "ratio", col("ratio").alias("back")))
    pairs = _members(pairs, members)
    ordered = col("a") < col("b")
    left, right = F.when(ordered, col("a")).otherwise(col("b")), F.when(ordered, col("b")).otherwise(col("a"))
    ratio = F.when(ordered, col("ratio")).otherwise(col("back")).alias("title_ratio")
    near = pairs.select("authority", left.alias("left"), right.alias("right"), ratio).where(col("title_ratio") >= title_threshold)
    same, lengths = col("left.path") == col("right.path"), F.length("left.path") + F.length("right.path")
    alike = 2 * F.least(F.length("left.path"), F.length("right.path")) >= lengths * F.lit(url_threshold) - F.lit(_SMALL)
    rated = near.where(same | alike).select(
        "authority",
        col("left.id").alias("left_link"),
        col("right.id").alias("right_link"),
        col("left.title").alias("left_title"),
        col("right.title").alias("right_title"),
        col("left.copies").alias("left_copies"),
        col("right.copies").alias("right_copies"),
        "title_ratio",
        col("left.path").alias("left_path"),
        col("right.path").alias("right_path"),
    )
    schema = StructType(rated.drop("left_path", "right_path").schema.fields).add("path_ratio", DoubleType())
    return rated.mapInArrow(_with_similar_paths(url_threshold), schema)


def similar_urls(table: DataFrame, url: str, *, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct (authority, path) with a ratio of the paths of at least ``threshold``.

    URLs with equal authority and path are similar as well; they are one row here, with their number in
    ``left_urls`` and ``right_urls``, and are listed by :func:`equal_urls`.
    """
    parts = split_url(url)
    rows = table.select(parts.authority.alias("authority"), parts.path.alias("path"), text_or_empty(url).alias("url"))
    rows = rows.groupBy("authority", "path").agg(F.min("url").alias("id"), F.count(F.lit(1)).alias("urls"))
    # Numbers in the order of the rows, so the smaller row is the left one.
    rows = _numbered_rows(rows.orderBy("id", "path"), "paths")
    pairs = _similar(rows, "path", threshold, within="authority")
    for side, name in (("left", "a_row"), ("right", "b_row")):
        pairs = pairs.join(rows.select(col("row").alias(name), col("id").alias(f"{side}_url"), col("urls").alias(f"{side}_urls")), name)
    return pairs.select("authority", "left_url", "right_url", "left_urls", "right_urls", "ratio")


def equal_urls(table: DataFrame, url: str) -> DataFrame:
    """Groups of URLs with equal authority and path."""
    parts = split_url(url)
    keyed = table.select(parts.authority.alias("authority"), parts.path.alias("path"), text_or_empty(url).alias("url"))
    return keyed.groupBy("authority", "path").agg(
        F.count(F.lit(1)).alias("urls"), F.min("url").alias("first_url")
    ).where("urls > 1")
