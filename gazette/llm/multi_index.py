"""Near-duplicate embeddings through an inverted multi-index.

Each vector of length 1 is cut in two halves, and each half has a codebook of its own; a pair of codewords is a cell of
the product grid. The codebooks, of as many words as give cells of about ``CELL_ROWS`` rows (at most ``MOST_WORDS`` per half),
are fitted to ``SAMPLE`` vectors at most; every row is indexed.

1. Equal vectors are one class with a weight from the start.
2. For a half the distance to a codeword's region is that to the plane between it and the nearest codeword. A vector
   walks the two sequences of regions in the order of these distances and visits every cell whose squared distances add
   up to a bound at most (multi-sequence traversal). The bound is set so that ``TARGET`` of neighbours put at random just
   at the threshold around sampled vectors lie in a visited cell, or visit back; nearer ones are found more often. With a
   target of 1 it is the squared distance of the threshold, which loses nothing and visits far more cells.
3. Rows and visitors of a cell meet in tasks, a large cell as a grid of blocks of rows and parts of visitors. All cosines
   of a block are taken in double precision, so no pair below the threshold links. A pair that visits both ways counts
   once. Tasks give numbers of links and a star for each connected part of a block, never pairs.

``recall`` measures the links found against brute force for a set of rows.

Defined cases: vectors that are null, zero, empty or hold null or non-finite entries link with nothing and are their own
component; shorter vectors count as ending in zeros; equal vectors link; a null vec_id is the smallest of its component
only if there is no other; rows that share a vec_id are rows of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, stored
from gazette.llm.jaccard import components
from gazette.llm.vectors import matrix, unit

NEAR = 0.95
TARGET = 0.999
SAMPLE = 1 << 14
SAMPLE_ENTRIES = 1 << 22
CELL_ROWS = 16
MOST_WORDS = 1024
BLOCK = 1024
VISITORS = 1 << 14


def codebook(rows: np.ndarray, words: int, rounds: int = 10) -> np.ndarray:
    """Centres of some rows, by Lloyd's iteration from evenly spaced rows of the sample."""
    words = min(words, len(rows))
    centres = rows[np.arange(words) * len(rows) // words]
    for _ in range(rounds):
        own = np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        centres = centres.copy()
        sums = np.add.reduceat(rows[order], at) if len(at) else rows[:0]
        centres[own[order][at]] = sums / np.bincount(own)[own[order][at]][:, None]
    return centres


class Half:
    """The codebook of one half of the vectors."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.apart = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0)) if len(centres) <= 64 else self._apart()

    def _apart(self) -> np.ndarray:
        square = (self.centres**2).sum(axis=1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * self.centres @ self.centres.T, 0))

    def regions(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each row, and the squared distance to the region of every codeword."""
        far = (self.centres**2).sum(axis=1) - 2 * rows @ self.centres.T
        own = far.argmin(axis=1)
        over = far - far[np.arange(len(rows)), own][:, None]
        apart = self.apart[own]
        return own, np.where(apart > 0, over / (2 * np.maximum(apart, 1e-300)), 0) ** 2


class MultiIndex:
    """Two codebooks and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, rows: int, near: float = NEAR, target: float = TARGET):
        cut = (sample.shape[1] + 1) // 2
        words = max(1, min(MOST_WORDS, math.isqrt(max(1, rows // CELL_ROWS))))
        self.cut = cut
        self.halves = [Half(codebook(sample[:, :cut], words)), Half(codebook(sample[:, cut:], words))]
        self.columns = len(self.halves[1].centres)
        self.bound = self._bound(sample[:2048], near, target)

    def regions(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.halves[0].regions(rows[:, : self.cut]), self.halves[1].regions(rows[:, self.cut :])]

    def _bound(self, rows: np.ndarray, near: float, target: float) -> float:
        """The bound within which ``target`` of random neighbours at the threshold are found, from either side."""
        turn = np.random.RandomState(13).normal(size=rows.shape)
        turn -= (turn * rows).sum(axis=1)[:, None] * rows
        length = np.sqrt((turn * turn).sum(axis=1))[:, None]
        other = near * rows + math.sqrt(1 - near * near) * np.divide(turn, length, out=np.zeros_like(turn), where=length > 0)
        here, there = self.regions(rows), self.regions(other)
        at = np.arange(len(rows))
        ways = [sum(far[at, own] for (_, far), (own, _) in zip(x, y)) for x, y in ((here, there), (there, here))]
        # Nothing nearer than the threshold lies beyond its own squared distance.
        return 2 * (1 - near) if target >= 1 else float(np.quantile(np.minimum(*ways), target))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row; then row and cell of all visits."""
        (own_a, far_a), (own_b, far_b) = self.regions(rows)
        order_a, order_b = np.argsort(far_a, axis=1, kind="stable"), np.argsort(far_b, axis=1, kind="stable")
        some_a, some_b = np.take_along_axis(far_a, order_a, axis=1), np.take_along_axis(far_b, order_b, axis=1)
        row, cell = [], []
        # Steps along the first sequence; the end on the second one only moves back.
        left, end = np.arange(len(rows)), (some_b <= self.bound).sum(axis=1)
        for step in range(some_a.shape[1]):
            left = left[some_a[left, step] <= self.bound]
            if not len(left):
                break
            while (back := left[(end[left] > 0) & (some_a[left, step] + some_b[left, np.maximum(end[left] - 1, 0)] > self.bound)]).size:
                end[back] -= 1
            left = left[end[left] > 0]
            n = end[left]
            each = np.repeat(left, n)
            column = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            row.append(each)
            cell.append(order_a[each, step] * self.columns + order_b[each, column])
        row, cell = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (row, cell))
        order = np.lexsort((cell, row))
        return own_a * self.columns + own_b, row[order], cell[order]


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _place(index: MultiIndex, width: int):
    """Rows (class, weight, embedding) with their cell and the cells they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, row, visits = index.place(unit(matrix(batch.column(2), width)))
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), _lists(visits, row, len(cell))]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "weight", "embedding", "home", "visits"])

    return run


class _Block:
    """The rows of one block of a cell, and what its visitors have linked so far."""

    def __init__(self, near: float):
        self.near, self.parts, self.ready = near, [], False

    def add(self, numbers: np.ndarray, weights: np.ndarray, rows: np.ndarray, visits: pa.Array) -> None:
        self.parts.append((numbers, weights, rows, visits))

    def _close(self) -> None:
        numbers, weights, rows, visits = zip(*self.parts)
        self.numbers, self.weights, self.rows = np.concatenate(numbers), np.concatenate(weights), np.concatenate(rows)
        sizes = np.concatenate([v.value_lengths().to_numpy() for v in visits])
        cells = np.concatenate([v.flatten().to_numpy() for v in visits]).astype(np.int64)
        self.keys = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) + cells)
        self.count, self.root, self.ready = np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes)), True

    def visit(self, numbers: np.ndarray, weights: np.ndarray, home: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, links counted here, class it hangs on) of the visitors with links."""
        if not self.ready:
            self._close()
        i, j = np.nonzero(rows @ self.rows.T >= self.near)
        other = numbers[i] != self.numbers[j]
        i, j = i[other], j[other]
        if not len(i):
            return numbers[:0], numbers[:0], numbers[:0]
        key = (j << 32) + home[i]
        both = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        here = ~both | (numbers[i] < self.numbers[j])
        counted = np.bincount(i[here], weights=self.weights[j[here]], minlength=len(rows)).astype(np.int64)
        self.count += np.bincount(j[here], weights=weights[i[here]], minlength=len(self.rows)).astype(np.int64)
        at = np.flatnonzero(np.diff(i, prepend=-1))
        while True:
            lowest = np.minimum.reduceat(self.root[j], at)
            up = np.arange(len(self.root))
            np.minimum.at(up, self.root[j], np.repeat(lowest, np.diff(np.append(at, len(i)))))
            if (up[self.root] == self.root).all():
                break
            self.root = up[self.root]
        return numbers[i[at]], counted[i[at]], self.numbers[lowest]

    def stars(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the rows of the block that have links."""
        if not self.ready:
            return (np.zeros(0, dtype=np.int64),) * 3
        some = (self.count > 0) | (self.root != np.arange(len(self.root)))
        return self.numbers[some], self.count[some], self.numbers[self.root[some]]


def _verify(near: float, width: int):
    """(class, links, class it hangs on) from rows (cell, block, part, visitor, class, weight, home, visits, embedding), where
    the rows of a block come before its visitors."""

    names = ["class", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            if not len(batch):
                continue
            cell, part, lot, visitor, numbers, weights, home = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7))
            rows = unit(matrix(batch.column(8), width))
            keys = np.stack([cell, part, lot, visitor])
            edge = np.flatnonzero(np.append(np.insert((keys[:, 1:] != keys[:, :-1]).any(axis=0), 0, True), True))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                now = (cell[a], part[a], lot[a])
                if now != key:
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.stars()], names)
                    key, block = now, _Block(near)
                if not visitor[a]:
                    block.add(numbers[a:b], weights[a:b], rows[a:b], batch.column(7).slice(a, b - a))
                elif block.parts:
                    found = block.visit(numbers[a:b], weights[a:b], home[a:b], rows[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.stars()], names)

    return run


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row, the key null where nothing can link; and (class, key, low, weight, embedding) of the
    different vectors."""
    huge = F.lit(float("inf"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists("embedding", lambda x: x != 0)
    key = F.when(fine, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.reverse("embedding")).alias("b")))
    rows = vectors.select("vec_id", "embedding").withColumn("key", key)
    classes = rows.filter("key is not null").groupBy("key").agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "key", "low", "weight", "embedding")
    return rows.select("vec_id", "key"), stored(classes, "vector-classes")


def near_links(classes: DataFrame, near: float = NEAR, target: float = TARGET) -> DataFrame:
    """(class, links, root): parts of the number of rows linked with a class, and edges that connect what is linked."""
    spark = classes.sparkSession
    bounded_batches(spark)
    rows, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    schema = "class bigint, links bigint, root bigint"
    if not rows:
        return spark.createDataFrame([], schema)
    sample = classes.orderBy("key.a").limit(max(256, min(SAMPLE, SAMPLE_ENTRIES // width))).select("embedding").toArrow()
    sample = unit(matrix(sample["embedding"].combine_chunks(), width))
    index = MultiIndex(sample, rows, near, target)
    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("class", "weight", "embedding").mapInArrow(_place(index, width), f"class bigint, weight bigint, embedding {kind}, home int, visits array<int>")
    placed = stored(placed, "placed-vectors")
    visits = placed.select(F.explode("visits").alias("cell"))
    sizes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n")).join(visits.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    # Row and visitor of a class alone in its cell are the same.
    grid = sizes.filter("m > 1").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / VISITORS).cast("int").alias("lots"))
    grid = stored(grid, "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = placed.withColumn("cell", F.col("home")).join(grid, "cell")
    homes = homes.select("cell", F.expr("cast(pmod(xxhash64(class), blocks) as int)").alias("block"), every("lots").alias("lot"), F.lit(0).alias("visitor"), "class", "weight", "home", "visits", "embedding")
    # Cells are chosen before the vectors are copied for them.
    callers = placed.withColumn("cell", F.explode("visits")).join(grid, "cell")
    callers = callers.select("cell", every("blocks").alias("block"), F.expr("cast(pmod(xxhash64(class, 1), lots) as int)").alias("lot"), F.lit(1).alias("visitor"), "class", "weight", "home", F.lit(None).cast("array<int>").alias("visits"), "embedding")
    met = homes.unionByName(callers).repartition("cell", "block", "lot").sortWithinPartitions("cell", "block", "lot", "visitor")
    return met.mapInArrow(_verify(near, width), schema)


def near_duplicates(vectors: DataFrame, near: float = NEAR, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, classes = classes_of(vectors)
    links = stored(near_links(classes, near, target), "vector-links")
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("class").alias("u"), F.col("root").alias("v"))).select(F.col("set").alias("class"), "root")
    named = classes.select("class", "key", "low", "weight").join(counts, "class", "left").join(roots, "class", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "class")), "vector-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = named.join(lowest, "root").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("known"), "component_id")
    out = rows.join(known, "key", "left")
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, found: DataFrame, near: float = NEAR, every: int = 20) -> float:
    """Share of the links of the rows whose vec_id is divisible by ``every`` that ``found`` counts; by brute force over all
    rows, in blocks that go through the driver one after the other."""
    some = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    fine = vectors.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)).select("embedding")
    want = {}
    asked = [r for r in some.toLocalIterator() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    for at in range(0, len(asked), 4096):
        block = unit(np.array([list(r.embedding) + [0.0] * (width - len(r.embedding)) for r in asked[at : at + 4096]]))

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(block), dtype=np.int64)
            for batch in batches:
                total += (block @ unit(matrix(batch.column(0), width)).T >= near).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block))), pa.array(total)], ["at", "n"])

        for r in fine.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            want[asked[at + r["at"]].vec_id] = r.n - 1
    total = sum(want.values())
    got = found.filter(F.col("vec_id") % every == 0).select("vec_id", "n_links").collect()
    return sum(r.n_links for r in got) / total if total else 1.0
