"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target, negation, reporting word, other. Five small transducers each follow
one matter through a clause: which word strikes, whether a target stands near, whether a negation holds, whether the
clause reports someone's speech, and how often it has struck before. Their composition reads a clause once and writes a
matched pattern for each strike: aimed, plain or damped (negated or reported), as an insult or a threat, or a further
strike of one clause. A text is scored by the weights of its matched patterns.

The insults and threats start from fixed words. A sample of at most ``LEARN_ROWS`` labelled texts of either label, by
hash of the identifier, adds words that stand in toxic texts nearly alone (at most ``LEXICON_MOST``) and strikes off
fixed words that clean texts use as often. It is the only part that reads a sample.

The weights start from those of the grammar and are fitted to labels. Counts per pattern are clipped at ``MOST``, so
all labelled rows fall into at most ``(MOST + 1) ** len(PATTERNS)`` kinds, which Spark counts over all rows; only these
counts reach the driver.

Defined cases: null and empty texts match nothing and get the score of texts without a match; labels without a
document, or null, teach nothing; without labels the grammar's own weights hold; a document with several labels
counts once for each; rows never meet in the scoring, so ties, repeated rows and null identifiers need no rule; a
long text is worked on alone; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, chunks, stored, texts
from gazette.llm.wordhash import Words

# The words of each class, in lower case.
INSULTS = """
    clown clowns coward cowards cretin creep dirtbag disgusting dumb dumbass filth fool fools freak garbage hideous
    idiot idiots idiotic imbecile jerk loser losers lowlife maggot moron morons moronic parasite pathetic pig pigs
    rat repulsive scum scumbag shithead stupid swine trash ugly useless vermin vile weakling worthless
    arschloch abschaum dummkopf idioten trottel versager wertlos widerlich
    abruti connard crétin débile imbécile minable ordure salaud
    asqueroso basura cabrón escoria estúpida estúpido idiota imbéciles inútil patético
""".split()
THREATS = """
    annihilate beat burn choke crush destroy die exterminate hang harm hurt kill murder punch shoot smash stab strangle
    suffer umbringen töten tuer matar
""".split()
TARGETS = """
    you your yours yourself u ur he she him her his they them their this that these those such
    du dich dir dein ihr euch tu te toi ton vous usted ustedes ti tus
""".split()
NEGATIONS = """
    not no never neither nor none without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot
    nicht kein keine nie pas jamais nunca jamás
""".split()
REPORTS = """
    said says say saying called calls calling wrote writes written quoted quotes quoting quote reported reports claimed
    claims alleged stated according word words term phrase
    sagte schrieb nannte dit dijo escribió
""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PATTERNS = ("insult_aimed", "insult_plain", "insult_damped", "threat_aimed", "threat_plain", "threat_damped", "again")
#: Weights of the grammar itself, and of a text without a match; the fit starts from them.
PRIOR = np.array([2.5, 2.0, 0.2, 2.0, 0.3, 0.0, 1.0])
PRIOR_BIAS = -3.0
#: Most that one pattern counts in a text, and the words over which a target or a negation holds.
MOST = 3
REACH = 4
#: Labelled texts of either label from which words are learned, and words learned at most.
LEARN_ROWS = 10_000
LEXICON_MOST = 5_000
#: A learned word stands in so large a part of the toxic texts at least, and weighs so much to the toxic side.
LEARN_SHARE = 0.004
LEARN_SIDE = 0.95
#: Strength with which the fit holds on to the prior.
HOLD = 1.0

_PART = np.ones(256, dtype=bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("'")]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?;\n")] = True


class Transducer:
    """States from 0 (a clause's start); ``step`` gives the next state and what is written for a class of word."""

    def __init__(self, states: int, step: Callable[[int, int], tuple[int, tuple]]):
        self.next = np.zeros((states, 6), dtype=np.int64)
        self.out: list[list[tuple]] = [[()] * 6 for _ in range(states)]
        for state, word in itertools.product(range(states), range(6)):
            self.next[state, word], self.out[state][word] = step(state, word)

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: states are pairs, and what both write is joined."""
        n = len(other.next)
        return Transducer(
            len(self.next) * n,
            lambda s, w: (int(self.next[s // n, w]) * n + int(other.next[s % n, w]), self.out[s // n][w] + other.out[s % n][w]),
        )


def _near(word: int, name: str) -> Transducer:
    """Writes ``name`` while a word of a class stands at most ``REACH`` words back."""
    return Transducer(REACH + 1, lambda s, w: (REACH if w == word else max(s - 1, 0), (name,) if s else ()))


@lru_cache(maxsize=1)
def grammar() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and the number of the written pattern (or -1) and of a further strike, per state and class."""
    strike = Transducer(1, lambda s, w: (0, {INSULT: ("insult",), THREAT: ("threat",)}.get(w, ())))
    # A report holds to the clause's end.
    reported = Transducer(2, lambda s, w: (1 if w == REPORT else s, ("reported",) if s else ()))
    again = Transducer(2, lambda s, w: (1 if w == INSULT else s, ("again",) if s and w == INSULT else ()))
    parts = [strike, _near(TARGET, "aimed"), _near(NEGATION, "negated"), reported, again]
    whole = reduce(Transducer.compose, parts)
    wrote = np.full((len(whole.next), 6, 2), -1)
    for state, word in itertools.product(range(len(whole.next)), range(6)):
        said = whole.out[state][word]
        if kind := next((x for x in ("insult", "threat") if x in said), None):
            damped = "negated" in said or "reported" in said
            wrote[state, word, 0] = PATTERNS.index(f"{kind}_{'damped' if damped else 'aimed' if 'aimed' in said else 'plain'}")
            if "again" in said and not damped:
                wrote[state, word, 1] = PATTERNS.index("again")
    return whole.next, wrote


Lexicon = tuple[np.ndarray, np.ndarray]


def lexicon(insults: list[str], threats: list[str]) -> Lexicon:
    """Hashes of the known words in order, and their classes."""
    groups = ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, threats), (INSULT, insults))
    known = {w: c for c, words in groups for w in words}
    hashes = Words([" ".join(known).encode("utf-8")]).hash
    order = np.argsort(hashes)
    return hashes[order], np.array(list(known.values()))[order]


_SPACED = bytes(32 if _PART[i] else i + 32 if 65 <= i <= 90 else i for i in range(256))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, with its label."""
    for batch in batches:
        values, toxic = texts(batch.column(0)), batch.column(1).to_pylist()
        for a, b in chunks(values):
            sets = [set((v or b"").translate(_SPACED).split()) for v in values[a:b]]
            of = np.repeat(np.array(toxic[a:b], dtype=bool), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array([w for x in sets for w in x], pa.binary()), pa.array(of)], ["word", "toxic"])


def learn_words(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Insults and threats: the fixed words that the labels do not refute, and learned insults."""
    bounded_batches(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    mark = F.xxhash64("doc_id")
    sides = [known.filter(side).orderBy(mark, "doc_id").limit(LEARN_ROWS) for side in (F.col("toxic"), ~F.col("toxic"))]
    # At most 2 * LEARN_ROWS rows of two small columns: safe to send everywhere.
    sample = F.broadcast(stored(sides[0].unionByName(sides[1]).dropDuplicates(["doc_id", "toxic"]), "toxic-sample"))
    chosen = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic or not clean:
        return INSULTS, THREATS
    counts = chosen.mapInArrow(_distinct, "word binary, toxic boolean").groupBy(F.col("word").cast("string").alias("word")).agg(
        F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")
    )
    bad, good = F.col("bad") / F.lit(float(toxic)), (F.col("good") + F.lit(0.5)) / F.lit(float(clean))
    counts = stored(counts.withColumn("side", bad / (bad + good)).filter(F.col("bad") + F.col("good") >= 3), "toxic-words")
    learned = counts.filter((F.col("bad") >= max(3, LEARN_SHARE * toxic)) & (F.col("side") >= LEARN_SIDE))
    insults = [r.word for r in learned.orderBy(F.desc("bad"), "word").limit(LEXICON_MOST).collect()]
    fixed = counts.filter(F.col("word").isin(INSULTS + THREATS) & (F.col("side") < 0.8))
    refuted = {r.word for r in fixed.select("word").collect()}
    return [w for w in dict.fromkeys(INSULTS + insults) if w not in refuted], [w for w in THREATS if w not in refuted]


def match(values: list[bytes | None], known: Lexicon) -> np.ndarray:
    """How often each pattern is matched in each text, at most ``MOST``."""
    out = np.zeros((len(values), len(PATTERNS)), dtype=np.int64)
    words = Words(values, lower=True, space=_PART)
    hashes, classes = known
    at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
    kind = np.where(hashes[at] == words.hash, classes[at], OTHER)
    stops = np.concatenate(([0], np.cumsum(_STOP[words.data])))[words.start]
    clause = np.cumsum(np.concatenate(([0], (np.diff(stops) > 0) | (np.diff(words.doc) > 0)))[: len(stops)])
    struck = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
    begin, end = np.searchsorted(clause, struck), np.searchsorted(clause, struck, side="right")
    # All clauses that hold a strike go through the composed transducer side by side, longest first.
    following, wrote = grammar()
    order = np.argsort(begin - end, kind="stable")
    begin, size = begin[order], (end - begin)[order]
    state = np.zeros(len(begin), dtype=np.int64)
    doc = words.doc[begin]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))
        word = kind[begin[:live] + k]
        said = wrote[state[:live], word]
        for column in (0, 1):
            hit = np.flatnonzero(said[:, column] >= 0)
            np.add.at(out, (doc[hit], said[hit, column]), 1)
        state[:live] = following[state[:live], word]
    return np.minimum(out, MOST)


def patterns(docs: DataFrame, known: Lexicon) -> DataFrame:
    """doc_id and the matched patterns of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in chunks(values):
                found = match(values[a:b], known)
                columns = (pa.array(found[:, i]) for i in range(len(PATTERNS)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", *PATTERNS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{p} bigint" for p in PATTERNS))


def fit(matched: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the patterns and of a text without one, from all rows that have a label."""
    known = matched.join(labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic"), "doc_id")
    rows = known.groupBy(*PATTERNS, "toxic").count().collect()
    x = np.array([[r[p] for p in PATTERNS] for r in rows], dtype=float).reshape(len(rows), len(PATTERNS))
    y = np.array([min(max(r["toxic"], 0), 1) for r in rows], dtype=float)
    n = np.array([r["count"] for r in rows], dtype=float)
    x = np.hstack([x, np.ones((len(rows), 1))])
    start = np.append(PRIOR, PRIOR_BIAS)
    weights = start.copy()
    hold = np.append(np.full(len(PRIOR), HOLD), 0.05)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - y)) + hold * (weights - start)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.clip(np.linalg.solve(curve, slope), -1, 1)
        weights = weights - move
        if np.abs(move).max() < 1e-9:
            break
    weights[:-1] = np.maximum(weights[:-1], 0)
    return weights[:-1], float(weights[-1])


def score(weights: np.ndarray, bias: float) -> Column:
    """Probability of a toxic text from its matched patterns."""
    total = sum((F.col(p) * F.lit(float(w)) for p, w in zip(PATTERNS, weights)), F.lit(float(bias)))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)), 6)


def fold(doc_id: Column) -> Column:
    """Remainder that parts the rows that are learned from (not 2) from those held out (2)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _trained(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Lexicon, np.ndarray, float]:
    """Matched patterns of every row, the words, and the fitted weights."""
    taught = labels.filter(fold(F.col("doc_id")) != 2)
    known = lexicon(*learn_words(docs, taught))
    matched = stored(patterns(docs, known), "toxic-patterns")
    return matched, known, *fit(matched, taught)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, and its matched patterns."""
    matched, _, weights, bias = _trained(docs, labels)
    return matched.select(
        "doc_id",
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        score(weights, bias).alias("score"),
        (score(weights, bias) >= threshold).cast("int").alias("predicted"),
        *PATTERNS,
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; no row leaves its task."""
    _, known, weights, bias = _trained(docs, labels)
    at = docs.columns.index("text")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(at))
            for a, b in chunks(values):
                total = match(values[a:b], known) @ weights + bias
                probability = np.round(1 / (1 + np.exp(-total)), 6)
                yield batch.slice(a, b - a).filter(pa.array(probability < threshold))

    return docs.mapInArrow(run, docs.schema)
