"""Distances between sources against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ROWS

from gazette.llm import divergence

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows: list[tuple], least: int, top: int | None) -> Counter:
    """Rows of the result for (text, lang, source) by dense loops over kept terms."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERMS.findall((text or "").translate(LOWER))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = Counter()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(g for g in count if g[0] == lang)

        def shares(n: Counter) -> dict:
            total = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}

        p = {g[1]: shares(count[g]) for g in groups}
        q = shares(sum((count[g] for g in groups), Counter()))
        for s in p:
            far = [(-sum(abs(p[s][t] - p[r][t]) for t in kept), r) for r in p if r != s]
            more = [(q[t] - p[s][t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", far), ("term", more)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out.update((lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found[: top if part == "term" else None]))
    return out


def result(df) -> Counter:
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_awkward_rows(odd, empty):
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    for least, top in ((1, 50), (2, 3), (99, 50)):
        assert result(divergence.source_divergence(odd, least, top)) == plain(rows, least, top)
    assert divergence.source_divergence(empty).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_random_texts(spark, monkeypatch, block):
    rng = random.Random(11)
    known = ["Ab", "aB", "été", "日本", "x" * 8, "x" * 9, "y" * 16, "y" * 17, "é" * 40, "z" * 33, "a1b", "zz"]
    rows = [(" ".join(rng.choices(known, k=rng.randint(0, 12))), rng.choice(["en", "fr"]), rng.choice("abcde")) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", None, None), (rows[0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, term int, n string").repartition(4)
    if block != divergence.BLOCK:
        # Blocks of two sources: the tasks get the number with their code.
        monkeypatch.setattr(divergence, "BLOCK", block)
        parts = list(_blocks(rows, 5, block))
        assert parts == sorted(plain_pairs(rows, 5))
        return
    assert result(divergence.source_divergence(df, 5)) == plain(rows, 5, 50)


def plain_pairs(rows, least):
    return [(lang, s, item, value) for (lang, s, part, item, value, _) in plain(rows, least, None) if part == "pair" and lang == "en" and s < item]


def _blocks(rows, least, block):
    """The distances of the English sources from the task's code alone, with small blocks and batches of three rows."""
    import pyarrow as pa

    count, docs = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        if lang == "en":
            found = TERMS.findall((text or "").translate(LOWER))
            count[source].update(found)
            docs.update(set(found))
    kept = sorted(t for t, n in docs.items() if n >= least)
    names = sorted(count)
    share = {s: (lambda n: lambda t: 1 + 10**9 * (n[t] + 5) // (sum(n[x] for x in kept) + 5 * len(kept)))(count[s]) for s in names}
    sent = []
    for i in range(-(-len(names) // block)):
        for j in range(i, -(-len(names) // block)):
            some = [k for k in range(len(names)) if k // block in (i, j)]
            sent += [("en", i, j, 0, "", k, share[names[k]]("")) for k in some]
            sent += [("en", i, j, 0, t, k, share[names[k]](t)) for t in kept for k in some if count[names[k]][t]]
    fields = ["lang", "i", "j", "part", "term", "at", "p"]
    batches = (pa.RecordBatch.from_pylist([dict(zip(fields, r)) for r in sent[k : k + 3]]) for k in range(0, len(sent), 3))
    far, seen = {}, {}
    for batch in divergence._distances(batches):
        for r in batch.to_pylist():
            if r["terms"] is None:
                far[r["a"], r["b"]] = r["value"]
            else:
                seen[r["a"], r["b"]] = r["terms"]
    for (a, b), value in sorted(far.items()):
        zero = abs(share[names[a]]("") - share[names[b]](""))
        yield "en", names[a], names[b], value + (len(kept) - seen[a // block, b // block]) * zero


def test_radix_order_is_stable():
    words = [np.random.RandomState(k).randint(0, 3, 500).astype(np.uint64) << np.uint64(40 * k) for k in range(2)]
    assert (divergence.radix_order(words) == np.lexsort((words[1], words[0]))).all()
