"""Whitening of embeddings with eigenvectors found by contour integration (FEAST).

Every entry ``c`` of a vector becomes the whole number ``x = floor(1024 * c) + 100000``. Spark sums up ``n``, the sums of
``x``, and then the products of ``z = x - m``, where ``m`` is the rounded mean; all of these are whole numbers and exact,
so the covariance is that of exact arithmetic, rounded once, however the rows are dealt out. What comes to the driver has
the size of the covariance, dimensions squared, and does not grow with the rows.

The leading eigenpairs of the covariance V come from there:

1. Householder reflections make V tridiagonal; the signs of the pivots of T - s count the eigenvalues below s (inertia).
   Bisection with these counts brackets the wanted eigenvalues and cuts them into intervals whose ends lie in gaps.
2. For each interval a circle around it is integrated by Gauss-Legendre quadrature: complex solves with z V_I - V filter a
   block of vectors towards the eigenvectors inside; Rayleigh-Ritz on the filtered block gives eigenpairs. Both repeat
   until the residuals are at rounding level.
3. An interval is accepted only if it holds as many eigenpairs as its inertia count; else the block grows.

Defined cases: vectors that are null or hold null or non-finite entries are left out; shorter vectors count as ending in
zeros; entries beyond 2**30 count as 2**30; eigenvalues of at most 1e-12 of the largest one have no component, so a table
of one vector, or of equal ones, gives no rows; of equal eigenvalues any basis may come; an empty table gives an empty
result; vec_id passes unchanged, whether null or repeated; other columns are not read. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.vectors import matrix, ragged

SCALE, SHIFT, MOST = 1024.0, 100_000, 2.0**30
COMPONENTS = 8
NODES = 8
SLICE = 4
NOTHING = 1e-12


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of whole numbers, and which rows they are."""
    good = ragged(column)[3]
    rows = np.clip(matrix(column.filter(pa.array(good)), width), -MOST, MOST)
    return np.floor(SCALE * rows).astype(np.int64) + SHIFT, np.flatnonzero(good)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, rows that reach it, sum of x) per task; place -1 counts rows."""
    count, total = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(count) - 1)), pa.array(count), pa.array(total)], ["place", "n", "part"])

    for batch in batches:
        entries, row, place, good = ragged(batch.column(0))
        some = good[row]
        x = np.floor(SCALE * np.clip(entries[some], -MOST, MOST)).astype(np.int64) + SHIFT
        width = max(len(count), int(place[some].max(initial=-1)) + 2)
        count, total = (np.pad(a, (0, width - len(a))) for a in (count, total))
        count[0] += good.sum()
        np.add.at(count, place[some] + 1, 1)
        np.add.at(total, place[some] + 1, x)
        if count[0] > 1 << 20:
            yield part()
            count[:] = total[:] = 0
    yield part()


def gram(z: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers below 2**42, by products of 20-bit limbs that doubles hold exactly."""
    small = np.abs(z).max(initial=0) < 1 << 20
    limbs = [z] if small else [z & 0xFFFFF, (z >> 20) & 0xFFFFF, z >> 40]
    limbs = [x.astype(np.float64) for x in limbs]
    out = 0
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            product = (a.T @ b).astype(np.int64)
            out = out + (product if small else product.astype(object) * (1 << 20 * (i + j)))
    return out


def _products(middle: np.ndarray):
    """(i, j, sum of z_i z_j) for i <= j, per task."""
    d = len(middle)
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = 0, 0

        def part() -> pa.RecordBatch:
            values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), values], ["i", "j", "part"])

        for batch in batches:
            x, _ = whole(batch.column(0), d)
            # 4,096 squares of 40 bits are whole in a double.
            for k in range(0, len(x), 4096):
                total = total + gram(x[k : k + 4096] - middle)
            rows += len(x)
            if rows > 1 << 21:
                yield part()
                total, rows = 0, 0
        if rows:
            yield part()

    return run


class Moments(NamedTuple):
    """Rows, sums of x and covariance of x."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def moments(vectors: DataFrame) -> Moments:
    """Exact moments of all whole vectors of the column ``embedding``."""
    only = vectors.select("embedding")
    sums = only.mapInArrow(_sums, "place bigint, n bigint, part bigint").groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    found = {r.place: (r.n, int(r.part)) for r in sums.collect()}
    n = found.pop(-1, (0, 0))[0]
    totals = [found[p][1] + (n - found[p][0]) * SHIFT for p in sorted(found)]
    if not n or not totals:
        return Moments(n, totals, np.zeros((0, 0)))
    middle = [round(t / n) for t in totals]
    parts = only.mapInArrow(_products(np.array(middle)), "i bigint, j bigint, part decimal(38,0)").groupBy("i", "j").agg(F.sum("part").alias("part"))
    rest = [t - n * m for t, m in zip(totals, middle)]
    covariance = np.zeros((len(totals), len(totals)))
    for r in parts.toLocalIterator():
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * int(r.part) - rest[r.i] * rest[r.j]) / (n * n)
    return Moments(n, totals, covariance)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        if (square := v @ v) > 0:
            v /= np.sqrt(square)
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny * 1e10
    out = np.zeros(len(shifts), dtype=np.int64)
    pivot = np.ones(len(shifts))
    for k, d in enumerate(diagonal):
        with np.errstate(over="ignore"):
            pivot = d - shifts - (side[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        out += pivot < 0
    return out


def brackets(diagonal: np.ndarray, side: np.ndarray, first: int, most: float) -> np.ndarray:
    """The ``first`` largest eigenvalues by bisection, falling."""
    d = len(diagonal)
    rank = d - np.arange(first)
    low, high = np.full(first, -most), np.full(first, most)
    for _ in range(56):
        mid = (low + high) / 2
        above = below(diagonal, side, mid) >= rank
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


def contour_pairs(v: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix between two bounds that are no eigenvalues."""
    d, center, radius = len(v), (low + high) / 2, (high - low) / 2
    angle, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (angle + 1) / 2)
    size = min(d, count + max(count, 8))
    rng = np.random.RandomState(12)
    block, scale = rng.normal(size=(d, size)), np.abs(v).sum(axis=1).max()
    worst = np.inf
    for k in range(rounds):
        # Half the circle: the other half gives the conjugate values.
        filtered = sum(w / 2 * (radius * t * np.linalg.solve((center + radius * t) * np.eye(d) - v, block.astype(complex))).real for w, t in zip(weight, turn))
        basis, _ = np.linalg.qr(filtered)
        values, turned = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ turned
        inside = (values > low) & (values < high)
        residual = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0) / scale
        if inside.sum() == count and (residual < 1e-15 or residual < 1e-12 and residual > worst / 2):
            return values[inside], block[:, inside]
        worst = residual if inside.sum() == count else np.inf
        if inside.sum() != count and k % 8 == 7 and size < d:
            size = min(d, 2 * size)
            block = np.concatenate((block, rng.normal(size=(d, size - block.shape[1]))), axis=1)
    raise ArithmeticError(f"{count} eigenvalues were counted between {low} and {high}, but not found")


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues above ``NOTHING`` of the largest, falling, and their eigenvectors as columns."""
    d = len(v)
    if not d or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, side = tridiagonal(v)
    around = np.abs(np.concatenate((side, [0]))) + np.abs(np.concatenate(([0], side)))
    most = float((np.abs(diagonal) + around).max()) * (1 + 1e-9)
    near = brackets(diagonal, side, d, most)
    wide = 1e-9 * near[0]
    k = min(k, int((near > NOTHING * near[0]).sum()))
    # Ends lie in the middle of gaps; eigenvalues without a gap between them stay together.
    gaps = np.append(near[:-1] - near[1:], max(near[-1], wide) * 2 + 4 * wide)
    ends, start = [], 0
    for i in range(d):
        if gaps[i] > wide and (i + 1 >= k or i + 1 - start >= SLICE):
            ends.append(i + 1)
            start = i + 1
        if ends and ends[-1] >= k:
            break
    values, vectors, start = [], [], 0
    high = most + 4 * wide
    for end in ends:
        low = near[end - 1] - gaps[end - 1] / 2
        count = int(np.subtract(*below(diagonal, side, np.array([high, low]))))
        # A far upper end would only widen the circle.
        found = contour_pairs(v, low, min(high, near[start] + max(near[start] - low, gaps[end - 1] / 2)), count)
        values.append(found[0])
        vectors.append(found[1])
        high, start = low, end
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:k], (basis @ turned)[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors * sign


def _whitened(fit: Moments, values: np.ndarray, vectors: np.ndarray):
    """(rows of a column) -> whitened rows, deviations, and which rows they are."""
    middle = np.array([round(t / fit.n) for t in fit.sums])
    rest = np.array([t - fit.n * int(m) for t, m in zip(fit.sums, middle)])
    weights = vectors / np.sqrt(values)
    shift = rest / fit.n

    def run(column: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
        x, at = whole(column, len(middle))
        z = x - middle
        far = float(np.abs(z).max(initial=0) + 1) * fit.n
        if far * far * len(middle) < 2.0**62:
            deviation = ((fit.n * z - rest) ** 2).sum(axis=1).tolist()
        else:
            deviation = ((fit.n * z.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
        return (z - shift) @ weights, [v if v < 1 << 63 else None for v in deviation], at

    return run


def identity_error(vectors: DataFrame, whitened, k: int) -> float:
    """Largest entry of the covariance of all whitened vectors, minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = whitened(batch.column(0))[0]
            n, total, products = n + len(w), total + w.sum(axis=0), products + w.T @ w
        i = [*range(k)] * k + [-1] * (k + 1)
        j = np.repeat(np.arange(k), k).tolist() + [*range(k), -1]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([*products.ravel(), *total, float(n)])], ["i", "j", "part"])

    sums = vectors.select("embedding").mapInArrow(run, "i bigint, j bigint, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    found = {(r.i, r.j): r.part for r in sums.collect()}
    n = found[-1, -1]
    return max(abs(found[i, j] / n - found[-1, i] * found[-1, j] / n / n - (i == j)) for i in range(k) for j in range(k))


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every whole vector and component."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = moments(vectors)
    values, components = leading(fit.covariance, k)
    m = len(values)
    if not m:
        return vectors.sparkSession.createDataFrame([], schema)
    whitened = _whitened(fit, values, components)
    error = identity_error(vectors, whitened, m)
    explained = values / np.trace(fit.covariance)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, deviation, at = whitened(batch.column(1))
            rows = np.repeat(np.arange(len(at)), m)
            arrays = [
                batch.column(0).take(pa.array(at[rows])).cast(pa.int64()),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(rows), fit.n)),
                pa.array(deviation, pa.int64()).take(pa.array(rows)),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(at))),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)
