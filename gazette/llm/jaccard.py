"""N-gram Jaccard join by prefix trees of sets in one global order.

A text's set holds its distinct shingles of ``SHINGLE`` words, as 63-bit numbers. Equal sets are one class from the start.

1. Sets that can link at all. Two linked sets share so many shingles that among the first by hash of each (three tenths
   of a set) at least 2 in 25 of its size are common. Sets with fewer sampled shingles that any other set samples too
   are linked with nothing and go no further.
2. Global order. The number of sets that hold a shingle is counted over all shingles of all sets left. Shingles of one
   set only cannot be shared; the others come in the order of that number (in steps of a sixteenth of its power of two),
   then by hash. A set's path is its shared shingles in this order. A set with less than four fifths of its shingles in its path links with
   nothing. Their texts are found by a join before which a Bloom filter drops most others, so that few texts are moved.
   Two sets that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, those of one set included.
3. Families. Every set meets one pivot per shingle at the beginning of its path: as many pairs as rows, however large a
   group is. The paths beside a pivot form a prefix tree, which is walked with the pivot's path. Links join to components.
4. Tree join of what is left. Sets that share such a shingle and lie in several components form a tree of the next
   ``WINDOW`` shingles of their paths, which all but those of the group's largest component walk. Paths with an equal beginning share the overlap
   counted so far; a subtree is left when what remains of either set cannot reach the overlap that its smallest set
   needs, or when it lies in the walker's own component. What is reached is verified as in 3 on whole paths. The first
   shingle of a pair finds it: of groups of the same sets only the first has a tree, and sets that also share one of the
   ``BEFORE`` shingles before are left to that shingle's group. Large
   groups are dealt into blocks, and each two blocks are a tree and its walkers. Pairs inside a component would change
   nothing.

So no link between different texts is lost for the components, a group of near copies costs its size, and many texts
around one passage, or variants of one text that do not link, give no pairs.

Defined cases: null texts, empty texts and texts without words have no shingles and are linked with nothing; texts of
fewer words than a shingle have one, all their words; equal texts are linked; a null doc_id comes after all others and
stands as null where it is the only one; rows with the same doc_id and different texts are rows of their own; an empty
table gives an empty result; other columns are not read by ``similar_groups`` and pass unchanged through
``one_of_each_group``. Shingles are compared by hash; 48 bits and their place in the order part those of one pair of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bounded_batches, chunks, stored, texts
from gazette.llm.wordhash import Words, mix

SHINGLE = 5
#: Shingles of a path that a tree of step 4 holds, and sets of a tree at most.
WINDOW = 96
BLOCK = 1024
#: Shingles before that of a group by which a pair is known from another group.
BEFORE = 48
PAIRS_PER_BATCH = 128
#: Bits of the filter of step 2 at most, and for each text.
FILTER_BITS, BITS_PER_TEXT = 1 << 25, 16
_LAST = np.iinfo(np.int64).max


def needed(a: int, b: int) -> int:
    """Least overlap of sets of these sizes that link: the overlap is 80 % of the union or more."""
    return -(-4 * (a + b) // 9)


def sample_size(n: np.ndarray) -> np.ndarray:
    """Shingles of a set that stand for it in step 1: those that may be missing in a linked set, and a tenth."""
    return n // 5 + (n + 9) // 10


def shingle_sets(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of some texts in one array, sorted within each text; the text of each, and the edges."""
    words = Words(values, lower=True)
    hashes, inside = words.windows(SHINGLE)
    at = np.flatnonzero(inside)
    doc, tokens = words.doc[at], hashes[at]
    count = np.diff(words.first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    short = []
    for i in few.tolist():
        own, value = words.hash[words.first[i] : words.first[i + 1]], np.array([count[i]], dtype=np.uint64)
        for h in own:
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + h)
        short.append(value[0])
    doc = np.concatenate((doc, few))
    tokens = np.concatenate((tokens, np.array(short, dtype=np.uint64))) >> np.uint64(1)
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
    doc, tokens = doc[new], tokens[new]
    return tokens, doc, np.searchsorted(doc, np.arange(len(values) + 1))


def set_keys(tokens: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets; 0 for the empty one."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens))))
    size = np.diff(edge).astype(np.uint64)
    key = mix(total[edge[1:]] - total[edge[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    return np.where(size > 0, key, np.uint64(0)).view(np.int64)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text a row (null, set, size, doc_id, mark); per different set of a chunk a row for each sampled shingle."""
    names = ["token", "set", "size", "doc_id", "mark"]
    for batch in batches:
        values, ids = texts(batch.column(1)), batch.column(0)
        for a, b in chunks(values):
            tokens, doc, edge = shingle_sets(values[a:b])
            keys, size, n = set_keys(tokens, edge), np.diff(edge), b - a
            marks = pa.array([(zlib.crc32(v or b"") << 31) + len(v or b"") for v in values[a:b]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(keys), pa.array(size), ids.slice(a, n), marks], names)
            first = np.zeros(n, dtype=bool)
            first[np.unique(keys, return_index=True)[1]] = True
            some = np.flatnonzero((np.arange(len(tokens)) - edge[doc] < sample_size(size)[doc]) & first[doc])
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[some].view(np.int64)), pa.array(keys[doc[some]]), pa.array(size[doc[some]]), nothing, nothing], names
            )


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, size, tokens) of the rows (set, text) whose text has that set."""
    for batch in batches:
        keys, values = batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(1))
        for a, b in chunks(values):
            tokens, _, edge = shingle_sets(values[a:b])
            good = set_keys(tokens, edge) == keys[a:b]
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(tokens.view(np.int64)))
            whole = pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.diff(edge)), lists], ["set", "size", "tokens"])
            yield whole.filter(pa.array(good))


class _Node:
    """Paths that agree up to ``end``: what they share since the node above, bounds of the sets below, paths that end here."""

    def __init__(self, tree: PrefixTree, order: np.ndarray, depth: int):
        low, high = tree.paths[order[0]], tree.paths[order[-1]]
        most = min(len(low), len(high)) - depth
        apart = np.flatnonzero(low[depth : depth + most] != high[depth : depth + most])
        self.end = depth + (int(apart[0]) if len(apart) else most)
        self.shared = low[depth : self.end]
        sizes, roots = tree.sizes[order], tree.roots[order]
        self.least, self.most = int(sizes.min()), int(sizes.max())
        self.reach = int((sizes - tree.places[order]).max())
        self.only = int(roots[0]) if (roots == roots[0]).all() else None
        ends = tree.length[order] == self.end
        self.here, self.below, self.branches = order[ends], order[~ends], None

    def nodes(self, tree: PrefixTree) -> list[_Node]:
        """The nodes below, made when a walk first comes here."""
        if self.branches is None:
            following = np.array([tree.paths[i][self.end] for i in self.below])
            cuts = np.flatnonzero(following[1:] != following[:-1]) + 1
            self.branches = [_Node(tree, part, self.end) for part in np.split(self.below, cuts) if len(part)]
        return self.branches


class PrefixTree:
    """Ordered paths of sets as a tree: sets with an equal beginning share a branch.

    A path may be part of its set: ``places`` counts what comes before it, which is taken as shared with no one, and
    ``sizes`` what the whole set holds. Without these a path is a set. Sets with equal ``roots`` need not be found.
    """

    def __init__(self, paths: list[np.ndarray], sizes=None, places=None, roots=None):
        self.paths = paths
        self.length = np.array([len(path) for path in paths])
        self.sizes = self.length if sizes is None else np.asarray(sizes)
        self.places = np.zeros(len(paths), dtype=np.int64) if places is None else np.asarray(places)
        self.roots = np.arange(len(paths)) if roots is None else np.asarray(roots)
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        self.top = _Node(self, np.array(order), 0)

    def linked(self, probe: np.ndarray, size: int | None = None, place: int = 0, root: int = -1) -> list[int]:
        """Numbers of the sets that can reach the overlap a link needs; with whole paths, of those that link."""
        n = len(probe) if size is None else size
        more = n - place > len(probe)
        out, todo = [], [(self.top, 0, 0, 0)]
        while todo:
            node, overlap, missed, passed = todo.pop()
            if node.only == root or 4 * n > 5 * node.most or 4 * node.least > 5 * n:
                continue
            shared = node.shared
            if len(shared):
                at = np.searchsorted(probe, shared)
                hits = int((probe[np.minimum(at, len(probe) - 1)] == shared).sum())
                # Behind the end of a cut probe a shingle may still be shared.
                known = int(np.searchsorted(shared, probe[-1], side="right")) if more else len(shared)
                overlap, missed = overlap + hits, missed + known - hits
                passed = int(np.searchsorted(probe, shared[-1], side="right"))
            left = n - place - (passed - overlap)
            if min(left, node.reach - missed) < needed(n, max(node.least, (4 * n + 4) // 5)):
                continue
            for i in node.here.tolist():
                m, place_i = int(self.sizes[i]), int(self.places[i])
                mine = left if m - place_i > self.length[i] else n - place - (len(probe) - overlap)
                if self.roots[i] != root and min(mine, m - place_i - missed) >= needed(n, m):
                    out.append(i)
            todo += [(below, overlap, missed, passed) for below in node.nodes(self)]
        return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, edge = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked pairs among rows (a, size_a, path_a, b, size_b, path_b); rows of one ``a`` that stand together share a tree."""
    for batch in batches:
        a, size_a, b, size_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        path_a, path_b = _lists(batch.column(2)), _lists(batch.column(5))
        edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
        u, v = [], []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if i == j:
                continue
            paths, sizes, n = path_b[i:j], size_b[i:j], int(size_a[i])
            tree = PrefixTree(paths, sizes, sizes - np.array([len(path) for path in paths]))
            found = tree.linked(path_a[i], n, n - len(path_a[i]))
            u += [a[i]] * len(found)
            v += [b[i + k] for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


class _Known:
    """Which of some sets share a shingle that comes before that of the group, so that another group finds the pair."""

    def __init__(self, before: list[np.ndarray]):
        values, of = np.concatenate(before), np.repeat(np.arange(len(before)), [len(b) for b in before])
        order = np.argsort(values, kind="stable")
        self.values, self.of, self.number = values[order], of[order], len(before)

    def among(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.number, dtype=bool)
        edges = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        for a, b in zip(*(edge.tolist() for edge in edges)):
            out[self.of[a:b]] = True
        return out


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets in different components that the trees of sorted rows do not rule out."""
    rest = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rest = rest.combine_chunks()
        keys = np.stack([rest.column(i).to_numpy() for i in range(3)])
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(edge):
            yield _walked(rest.slice(0, int(edge[-1])), np.concatenate(([0], edge)).tolist())
            rest = rest.slice(int(edge[-1]))
    if rest is not None and rest.num_rows:
        yield _walked(rest, [0, rest.num_rows])


def _walked(rows: pa.Table, edge: list[int]) -> pa.RecordBatch:
    low, high, block, sets, size, place, root = (rows.column(i).to_numpy() for i in range(1, 8))
    before, paths = (_lists(pa.concat_arrays(rows.column(i).chunks)) for i in (8, 9))
    u, v = [], []
    for i, j in zip(edge[:-1], edge[1:]):
        if (root[i:j] == root[i]).all():
            continue
        found, n = np.unique(root[i:j], return_counts=True)
        major = found[n.argmax()]
        one, here = low[i] == high[i], np.arange(i, j)
        members = here if one else here[block[i:j] == high[i]]
        walkers = here if one else here[block[i:j] == low[i]]
        # Of two components one is not the largest, so its sets walk; those of both sides where there are two blocks.
        for walk, stay in [(walkers, members)] if one else [(walkers, members), (members, walkers)]:
            tree = known = None
            for p in walk[root[walk] != major].tolist():
                need = -(-4 * (size[stay] + size[p]) // 9)
                fits = (root[stay] != root[p]) & (place[stay] <= size[stay] - need) & (place[p] <= size[p] - need)
                if not fits.any():
                    continue
                known = known or _Known([before[k] for k in stay])
                fits &= ~known.among(before[p])
                if not fits.any():
                    continue
                tree = tree or PrefixTree([paths[k] for k in stay], size[stay], place[stay], root[stay])
                for k in tree.linked(paths[p], int(size[p]), int(place[p]), int(root[p])):
                    if fits[k] and (not one or root[stay[k]] == major or root[p] < root[stay[k]]):
                        u.append(sets[p])
                        v.append(sets[stay[k]])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, paths: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    spark = pairs.sparkSession
    with_b = stored(pairs, f"{label}-pairs").join(paths.toDF("b", "size_b", "path_b"), "b")
    both = with_b.join(paths.toDF("a", "size_a", "path_a"), "a").select("a", "size_a", "path_a", "b", "size_b", "path_b")
    # Two sets in every row.
    bounded_batches(spark, PAIRS_PER_BATCH)
    out = stored(both.mapInArrow(_verify, "u bigint, v bigint"), f"{label}-links")
    bounded_batches(spark)
    return out


def may_be_among(keys: DataFrame, column: Column) -> Column:
    """Whether a bigint column may be among the column ``key`` of some rows: false only where it is not.

    The filter has ``FILTER_BITS`` bits at most, whatever the input.
    """
    bits = min(FILTER_BITS, 1 << max(1 << 15, BITS_PER_TEXT * keys.count()).bit_length())
    both = F.array(*(F.pmod(part, F.lit(bits)) for part in (F.col("key"), F.shiftrightunsigned("key", 32))))
    words = keys.select(F.explode(both).alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set")
    )
    table, packed = words.toArrow(), np.zeros(bits // 64, dtype=np.uint64)
    packed[table["word"].to_numpy()] = table["set"].to_numpy().view(np.uint64)

    def test(key: pa.Array) -> pa.Array:
        value, found = key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), True
        for slot in (value & np.uint64(bits - 1), value >> np.uint64(32) & np.uint64(bits - 1)):
            found &= packed[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
        return pa.array(found)

    return F.arrow_udf(test, "boolean")(column)


def ordered_paths(docs: DataFrame, samples: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, size, path) of the sets that can link, steps 1 and 2."""
    again = samples.groupBy("token").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high").select("token")
    # Distinct keys, dealt evenly: a partition of them is small, and the larger side needs no sort.
    # Equal sets of several chunks count several times, so no set is lost; the path decides exactly.
    common = samples.join(again.hint("shuffle_hash"), "token").groupBy("set", "size").agg(F.count("*").alias("n")).filter("25 * n >= 2 * size")
    wanted = stored(common.select("set").join(classes, "set"), "wanted")
    plain = F.coalesce("text", F.lit(""))
    mark = F.shiftleft(F.crc32(F.encode(plain, "UTF-8")), 31) + F.octet_length(plain)
    source = docs.select("text", F.coalesce("doc_id", F.lit(int(_LAST))).alias("first"), mark.alias("mark"))
    key = F.xxhash64("first", "mark")
    source = source.filter(may_be_among(wanted.select(key.alias("key")), key))
    # Repeated rows give a text once; texts that share identifier and mark by chance are told apart by their sets.
    found = source.join(wanted, ["first", "mark"]).dropDuplicates(["first", "mark", "set", "text"]).select("set", "text")
    sets = stored(found.mapInArrow(_own_sets, "`set` bigint, size bigint, tokens array<bigint>"), "sets")
    single = sets.select("set", "size", F.explode("tokens").alias("token"))
    # 48 bits of the hash behind the frequency, in steps of its logarithm that part all counts below 1,400.
    place = F.least(F.floor(1024 * F.log2("n")), F.lit(32767)).cast("bigint")
    order = single.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    order = order.select("token", F.shiftleft(place, 48).bitwiseOR(F.shiftright("token", 15)).alias("key"))
    paths = single.join(order.hint("shuffle_hash"), "token").groupBy("set", "size").agg(F.sort_array(F.collect_set("key")).alias("path"))
    return stored(paths.filter("5 * size(path) >= 4 * size").select("set", "size", "path"), "paths")


def components(links: DataFrame) -> DataFrame:
    """(set, root) for every set in a link: the smallest set it is connected with.

    Each round hangs the larger neighbours of every set on its smallest neighbour, then all neighbours of the rest; the
    rounds end when every set hangs on a root. Minima are taken before the shuffle, so a set with very many links is no
    burden. A round makes at most two rows of an edge, which its end makes distinct.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below = [f("v").alias(name) for f, name in ((F.min, "least"), (F.max, "most"))]
        near = both.groupBy("u").agg(*below, F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("parent"))
        near = stored(near.select("u", F.least("u", "least").alias("low"), "least", "most", "parent"), "near")
        # A set with two smaller neighbours, or with a smaller and a larger one, still has to move.
        if near.filter("parent is not null and (parent > least or most > u)").isEmpty():
            return near.filter("parent is not null").select(F.col("u").alias("set"), F.col("parent").alias("root"))
        large = both.join(near.select("u", "low"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        pairs = F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
        edges = stored(large.join(low, "u").select(pairs.alias("e")).select("e.u", "e.v").filter("u != v").distinct(), "edges")


def _labelled(sets: DataFrame, roots: DataFrame) -> DataFrame:
    return sets.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, size, doc_id) per row, and (set, root) for the sets in a link."""
    bounded_batches(docs.sparkSession)
    schema = "token bigint, `set` bigint, size bigint, doc_id bigint, mark bigint"
    rows = stored(docs.select("doc_id", "text").mapInArrow(_samples, schema), "samples")
    members = rows.filter("token is null").select("set", "size", "doc_id")
    # One document of each class: its smallest identifier, and the mark of its text.
    named = rows.filter("token is null and size > 0").select("set", F.struct(F.coalesce("doc_id", F.lit(int(_LAST))).alias("first"), "mark").alias("one"))
    classes = named.groupBy("set").agg(F.min("one").alias("one")).select("set", "one.first", "one.mark")
    paths = ordered_paths(docs, rows.filter("token is not null").select("token", "set", "size"), classes)
    # The beginning of a path: what of the first n - ceil(0.8 n) + 1 shingles is in it.
    starts = paths.select("set", "size", "path", F.posexplode(F.expr("slice(path, 1, size(path) - int((4 * size + 4) div 5) + 1)")).alias("at", "token"))
    starts = stored(starts.select("token", "set", "size", F.expr("size - size(path) + at").alias("place")), "starts")
    # One pivot per shingle, where sizes and places let both reach the overlap if it is the first shared one.
    groups = starts.groupBy("token").agg(F.min(F.struct("set", "size", "place")).alias("pivot"), F.max("set").alias("high")).filter("pivot.set < high")
    groups = groups.select("token", F.col("pivot.set").alias("a"), F.col("pivot.size").alias("size_a"), F.col("pivot.place").alias("place_a"))
    need = "((4 * (size + size_a) + 8) div 9)"
    shared = stored(starts.join(groups, "token"), "shared")
    pairs = shared.filter("a != `set`").filter(f"place <= size - {need} and place_a <= size_a - {need}")
    links = _links(pairs.select("a", F.col("set").alias("b")).distinct(), paths, "pivot")
    roots = components(links)
    # Groups that still hold several components.
    placed = stored(_labelled(shared.select("token", "set", "size", "place"), roots), "placed")
    same = [F.bit_xor(F.xxhash64("set", F.lit(i))).alias(name) for i, name in enumerate(("sets", "again"))]
    torn = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *same)
    # Of groups of the same sets the first: what two of them share first is no later one.
    torn = torn.filter("low < high").groupBy("n", "sets", "again").agg(F.min("token").alias("token"))
    torn = torn.select("token", F.expr(f"int((n + {BLOCK - 1}) div {BLOCK})").alias("blocks"))
    dealt = placed.join(torn, "token").withColumn("block", F.expr("pmod(hash(`set`), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = ["token", "low", "high"]
    dealt = dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "size", "place", "root")
    # Only what is walked carries shingles.
    at = "int(place - size + size(path))"
    part = F.expr(f"slice(path, {at} + 1, {WINDOW})").alias("part")
    before = F.expr(f"slice(path, greatest({at} - {BEFORE}, 0) + 1, least({at}, {BEFORE}))").alias("before")
    dealt = dealt.join(paths.select("set", "path"), "set").select(*key, "block", "set", "size", "place", "root", before, part)
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    walks = dealt.mapInArrow(_walks, "a bigint, b bigint")
    more = _links(walks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), paths, "cross")
    if more.isEmpty():
        return members, roots
    return members, components(roots.toDF("u", "v").union(more))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of every row."""
    members, roots = similar_sets(docs)
    placed = stored(_labelled(members, roots), "members")
    some = placed.filter("size > 0")
    lowest = stored(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    linked = some.join(lowest, "root").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = placed.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, with all their columns.

    Rows that share a doc_id are one document, which stays if one of them does. Texts without words stay.
    """
    verdicts = similar_groups(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = stored(verdicts.filter("not stays").select(F.col("doc_id").alias("_llm_gone")), "near-copies")
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._llm_gone), "left_anti")
