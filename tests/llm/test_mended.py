"""Cases that once failed: long varied texts, growing shards, clashing names, long keys; and plain versions."""

from __future__ import annotations

import random
import subprocess
import sys

import numpy as np
from cases import PASSAGE, ROWS

from gazette.llm import exact_dedup, jaccard, langid, mixing, pseudonyms, sharding


def plain_bundle(text):
    """The sum over all trigrams of letters and spaces, one after the other."""
    letters = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    total, n = np.zeros(langid.DIMENSIONS), 0
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        # No two spaces in a row, and none in the middle.
        if b == " " or (a == " " and b == " ") or (b == " " and c == " "):
            continue
        x, y, z = (langid.letter_vectors(np.array([ord(i)]))[0].astype(float) for i in (a, b, c))
        total += np.roll(x, 2) * np.roll(y, 1) * z
        n += 1
    return total, n


def test_bundles_by_plain_sums(monkeypatch):
    rng = random.Random(3)
    values = ["", None, "a", "été ça", "x " * 5] + ["".join(rng.choices("abcdé ñ,1", k=rng.randint(1, 200))) for _ in range(15)]
    want = [plain_bundle(v) for v in values]
    for kinds in (7, 1 << 13):
        monkeypatch.setattr(langid, "KINDS", kinds)
        vectors, n = langid.bundles(values)
        assert n.tolist() == [m for _, m in want]
        assert np.allclose(vectors, np.array([v for v, _ in want]))


def test_languages_by_plain_cosines(spark):
    rng = random.Random(4)
    parts = {"en": "the of and ing", "fr": "le des que eau", "de": "der die ung sch"}
    rows = [(i, " ".join("".join(rng.choices(parts[lang].split(), k=2)) for _ in range(8)), lang) for i, lang in enumerate(list(parts) * 12)]
    got = {r.doc_id: r for r in langid.language_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    learned = {lang: sum(plain_bundle(t)[0] / plain_bundle(t)[1] for i, t, x in rows if x == lang and not got[i].held_out) for lang in parts}
    learned = {k: v / np.linalg.norm(v) for k, v in learned.items()}
    middle = sum(learned.values()) / len(learned)

    def unit(v):
        return v / np.linalg.norm(v)

    for i, text, _ in rows:
        own = unit(unit(plain_bundle(text)[0]) - middle)
        cosines = {k: float(own @ unit(v - middle)) for k, v in learned.items()}
        best = max(cosines, key=cosines.get)
        assert got[i].lang_pred == best and abs(got[i].score - min(1, max(0, cosines[best]))) < 1e-4


def test_a_long_varied_text_needs_bounded_memory():
    code = (
        "import random, resource; from gazette.llm import langid; rng = random.Random(1);"
        "text = ''.join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_700_000));"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; langid.bundles([text]);"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 600


def test_shards_grow_from_call_to_call(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'x' as text")
    before = None
    for shards in (1, 2, 7, 8, 9, 24, 25, 31, 32, 33):
        rows = {r.doc_id: r for r in sharding.hash_tree_shards(docs, shards).collect()}
        if before and before[0] + 1 == shards:
            assert {i: r.shard for i, r in rows.items()} == before[1]
        assert all(r.grown_shard in (r.shard, shards) for r in rows.values())
        before = (shards, {i: r.grown_shard for i, r in rows.items()})


def test_names_of_operators_do_not_clash(spark):
    names = ["target", "source_size", "first_weight", "last_weight", "_llm_key", "_llm_digest", "_llm_size", "_llm_gone", "set", "token", "root", "column_3"]
    rows = [(*r[:4], *range(len(names))) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    for stage in (mixing.mixed_documents, exact_dedup.drop_duplicates_exact, jaccard.one_of_each_group):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in out.collect())
        assert stage(docs.limit(0)).count() == 0


def test_no_long_key_stays_in_clear_text():
    keys = ["sk-" + "aB3x" * 18, "sk-proj-" + "a1B2c3" * 8, "sk-ant-api03-" + "x9_Yz-" * 7 + "Q1", "sk-" + "k" * 64, "sk-" + "abc12" * 4]
    net = pseudonyms.Feistel(b"secret")
    for key in keys:
        text = f"see {key} here"
        hidden = pseudonyms.replace(net, text)[0]
        assert key not in hidden and len(hidden) == len(text) and hidden.startswith("see sk-") and hidden.endswith(" here")
        assert pseudonyms.replace(net, hidden, back=True)[0] == text
    for word in ("sk-learn", "risk-averse", "sk-some-long-hyphenated-name-without-any", PASSAGE.replace("1", "x")):
        assert pseudonyms.replace(net, f"see {word} here")[0] == f"see {word} here"
