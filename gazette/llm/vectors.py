"""List columns of numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all rows as doubles (null is NaN), the row and place of each, and whether a row is whole.

    A row is whole if it and its entries are neither null nor infinite nor NaN.
    """
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(entries)) - np.repeat(np.cumsum(size) - size, size)
    broken = np.bincount(row[~np.isfinite(entries)], minlength=len(size)) > 0
    return entries, row, place, ~broken & column.is_valid().to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole rows as a matrix; shorter ones end in zeros."""
    entries, row, place, _ = ragged(column)
    out = np.zeros((len(column), width))
    out[row, place] = entries
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled first, so neither huge nor tiny entries are lost."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
