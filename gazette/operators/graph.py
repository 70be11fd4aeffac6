"""Co-occurrence of topics or authors as a weighted edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Names of one article that take part in pairs, in sorted order, where the caller gives no other number.
NAMES_PER_ARTICLE = 24


def _edges(articles: DataFrame, names: Column, most: int | None) -> DataFrame:
    """Pairs of the first ``most`` sorted names of each article (None: of all), counted over all."""
    kept = F.array_sort(F.filter(names, lambda n: n != ""))
    if most is not None:
        kept = F.slice(kept, 1, most)
    listed = articles.select(kept.alias("names"))
    pairs = F.flatten(
        F.transform(
            "names",
            lambda left, i: F.transform(
                F.slice(col("names"), i + 2, F.size("names")), lambda right: F.struct(left.alias("left"), right.alias("right"))
            ),
        )
    )
    exploded = listed.select(F.explode_outer(pairs).alias("edge")).where("edge is not null")
    return exploded.groupBy("edge.left", "edge.right").agg(F.count(F.lit(1)).alias("weight"))


def topic_edges(tagged: DataFrame, most: int | None = NAMES_PER_ARTICLE) -> DataFrame:
    return _edges(tagged, F.map_keys("matched_entities"), most)


def author_edges(papers: DataFrame, most: int | None = NAMES_PER_ARTICLE) -> DataFrame:
    return _edges(papers, col("authors"), most)


def node_weights(edges: DataFrame) -> DataFrame:
    """Sum of the weights of the edges at a node; an edge from a node to itself counts once."""
    ends = F.array_distinct(F.array("left", "right"))
    return edges.select(F.explode(ends).alias("node"), "weight").groupBy("node").agg(
        F.sum("weight").cast("bigint").alias("weight")
    )
