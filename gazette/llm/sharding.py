"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A document descends region, rack and shard. At each node every child draws ``-ln(u) / weight``, with ``u`` in (0, 1)
from the MD5 of the document's key and the child's path; the smallest draw wins. A child's draw depends on nothing
but its own path and weight. So a changed weight moves documents into or out of the subtree that changed, and a new
shard, which comes as a region of its own, only takes documents into itself: law ``key``. That holds from call to call:
``grown_shard`` of ``n`` shards is ``shard`` of ``n + 1``, but for the step to ``base`` shards, where a flat tree gets its
hierarchy.

Defined cases: a null doc_id has the empty key; a null text has size 8 and the CRC-32 of no bytes, 0; repeated rows
share a shard and have slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of each shard, in which slots are numbered apart. A piece holds one part in 4,096 of a shard.
PIECES = 4096
_RANGE = float(1 << 52)


@dataclass(frozen=True)
class Tree:
    """``nodes``: the children of each path, as (path, weight); the children of the last level end in ``/<shard>``."""

    nodes: dict[str, list[tuple[str, float]]]

    @staticmethod
    def balanced(shards: int, racks: int = 4, per_rack: int = 2, base: int = 24) -> Tree:
        """The first ``base`` shards in regions of ``racks`` racks of ``per_rack`` shards; all others are regions of one shard.

        So the trees of ``base`` shards and more grow from each other by one shard at a time, and so do those of fewer
        shards, which have regions of one shard only.
        """
        tree, whole = Tree({"": []}), base - base % (racks * per_rack) if shards >= base else 0
        for first in range(0, whole, racks * per_rack):
            region = f"g{first}"
            tree.nodes[region] = []
            tree.nodes[""].append((region, float(racks * per_rack)))
            for k in range(racks):
                rack = f"{region}/k{k}"
                tree.nodes[region].append((rack, float(per_rack)))
                tree.nodes[rack] = [(f"{rack}/{first + k * per_rack + i}", 1.0) for i in range(per_rack)]
        for shard in range(whole, shards):
            tree = tree.with_shard(shard)
        return tree

    def with_shard(self, shard: int, weight: float = 1.0) -> Tree:
        """The tree with a further region that holds one shard."""
        region = f"g{shard}"
        rack = f"{region}/k0"
        more = {region: [(rack, weight)], rack: [(f"{rack}/{shard}", weight)], "": [*self.nodes[""], (region, weight)]}
        return Tree(self.nodes | more)

    def with_weight(self, path: str, weight: float) -> Tree:
        """The tree with another weight of one node."""
        parent = path.rpartition("/")[0]
        return Tree(self.nodes | {parent: [(p, weight if p == path else w) for p, w in self.nodes[parent]]})


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _children(tree: Tree) -> Column:
    """The tree as a constant: path of a node -> its children."""
    entries = []
    for path, children in tree.nodes.items():
        entries += [F.lit(path), F.array(*(F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in children if w > 0))]
    return F.create_map(*entries)


def _descend(rows: DataFrame, tree: Tree, out: str) -> DataFrame:
    """``rows`` (with a non-null string column ``key``) and the shard: one step per level."""
    at = F.lit("")
    for level in range(3):
        children = F.element_at(_children(tree), at)

        def draw(child: Column) -> Column:
            u = (_hex(F.concat(F.col("key"), F.lit("|"), child["path"]), 13) + F.lit(0.5)) / F.lit(_RANGE)
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"))

        rows = rows.withColumn(f"{out}_{level}", F.array_min(F.transform(children, draw))["path"])
        at = F.col(f"{out}_{level}")
    return rows.withColumn(out, F.element_at(F.split(at, "/"), -1).cast("int")).drop(*(f"{out}_{k}" for k in range(3)))


def hash_tree_shards(docs: DataFrame, shards: int = 24, base: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard with one shard more) of every row.

    ``base`` is the number of shards that the hierarchy was laid out for, and stays the same as shards are added.
    """
    tree = Tree.balanced(shards, base=base)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
    )
    rows = _descend(_descend(rows, tree, "shard"), tree.with_shard(shards), "grown_shard")
    rows = rows.withColumn("piece", _hex(F.col("key"), int(math.log2(PIECES)) // 4).cast("int")).drop("key")
    # Slots: rows of a piece are numbered apart, from the count of all pieces before it.
    counts = rows.groupBy("shard", "piece").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")
    starts = counts.select("shard", "piece", before.alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("number", number)
        .join(starts, ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("number") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
