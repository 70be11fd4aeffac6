"""Words of many texts at once as numpy arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.RandomState(20).randint(1, 2**63 - 1, size=256, dtype=np.int64).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes: a polynomial read from running sums."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    room = 1 << max(21, int(len(data)).bit_length())
    up, down = _powers(room)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, in order.

    ``data`` holds all bytes (texts are kept apart by a line feed); ``start``, ``end``, ``doc`` and ``hash`` are
    per word; ``lower`` lower-cases A-Z; ``space`` says which bytes part words; ``first`` is the number of the first word of each text, with the number of all words at its end.
    """

    def __init__(self, values: list[bytes | None], lower: bool = False, space: np.ndarray = _SPACE):
        data = np.frombuffer(b"\n".join([*(v or b"" for v in values), b""]), dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        size = np.array([len(v or b"") + 1 for v in values], dtype=np.int64)
        self.text_end = np.cumsum(size)
        edge = np.diff(np.concatenate(([True], space[data], [True])).astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.text_end, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(values) + 1))
        self.hash = span_hashes(data, self.start, self.end)

    def windows(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they lie in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        out = np.full(m, seed, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + m]
        return mix(out), self.doc[:m] == self.doc[n - 1 : n - 1 + m]
