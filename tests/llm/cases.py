"""Small tables with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "other")
PASSAGE = " ".join(f"p{i}" for i in range(20))

#: doc_id, text, lang, source, n_chars and a column whose name operators might use themselves.
ROWS = [
    (1, BASE, "en", "a", 1, "x"),
    (2, BASE, "en", "a", 1, "x"),
    (2, BASE, "en", "a", 1, "x"),
    (3, NEAR, "en", "b", 1, "x"),
    (4, BASE.replace(" ", "\n\t"), "en", "b", 1, None),
    (5, None, None, None, None, None),
    (6, "", "de", "b", 0, "x"),
    (7, " \n\t ", "de", None, 0, "x"),
    (8, "one two three", "fr", "c", 1, "x"),
    (9, "One TWO three", "fr", "c", 1, "x"),
    (10, f"start {PASSAGE} end of it", "en", "a", 1, "x"),
    (11, f"{PASSAGE} {PASSAGE} tail", "en", None, 1, "x"),
    (None, f"{PASSAGE} no id", "en", "a", 1, "x"),
    (None, BASE, None, "a", 1, "x"),
    (12, "été ça   日本語 👍 x​y", "fr", "d", 1, "x"),
    (13, "la " * 30_000, "es", "d", 1, "x"),
    (14, "x" * 20_000, "es", "d", 1, "x"),
    (15, "line one is here\nline one is here\nline two\n\nline two", "en", "e", 1, "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string"


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    own = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set())


def groups(rows: list[tuple[int | None, str | None]]) -> Counter:
    """(doc_id, set size, smallest linked doc_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        own = [x for x in (low.get(find(i)), doc) if x is not None]
        low[find(i)] = min(own) if own else None
    return Counter((doc, len(sets[i]), low[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def removed(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple[int, str]]:
    """Words and kept words of each text, by a table of all windows."""
    last = 1 << 63
    first: dict[tuple, int] = {}
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, last), last if doc is None else doc)
    out = []
    for doc, text in rows:
        own = words(text)
        keep = [True] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < (last if doc is None else doc):
                keep[i : i + window] = [False] * window
        out.append((len(own), " ".join(w for w, k in zip(own, keep) if k)))
    return out
