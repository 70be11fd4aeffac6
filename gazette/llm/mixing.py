"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source gets a target number of words: its weighted share of the demand, but at most ``CEILING`` times its own
words, with the excess shared by weight among the others. Its weight runs linearly over training from a first to a
last value (``SCHEDULE``). The integral of that line says how many of its words are used up to a time; its inverse
gives each document, from the words that stand before it in its source's order, the time at which it is read. A
source with a target above its size is passed through again. Documents are range-sorted by that time.

Running sums of words are taken in pieces of a source (by hash of the document), so no task holds a whole source.

Defined cases: null and empty texts have no words, are never taken and stand at the end; a null source is a source
of its own, last in order; a null doc_id has the empty key; repeated rows are documents of their own; an empty
table gives an empty result; other columns pass unchanged through ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import numbered_columns, stored

#: Weights of the sources in order, repeating; demand as a part of all words; passes over a source at most.
WEIGHTS = (5, 2, 1)
DEMAND = 1.5
CEILING = 2
#: First and last relative weight of a source over training, by the same order.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Ticks of training time.
TICKS = 1_000_000_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    """60 bits that order the documents of a source."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values)).cast("int") + 1)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Size, target and schedule of each source; ``sizes`` has source and _llm_size. One row per source."""
    sources = sizes.groupBy("source").agg(F.sum("_llm_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("rank", rank).withColumn("weight", _cycle(F.col("rank"), WEIGHTS).cast("double"))
    # Sources reach their ceiling in the order of ceiling over weight. The first that would not, sets the level.
    cap = F.col("source_size").cast("double") * CEILING
    rows = rows.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("ratio", "rank")
    every = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.sum(F.col("source_size").cast("double")).over(every) * DEMAND
    before = F.sum("cap").over(filled) - F.col("cap")
    rest = F.sum("weight").over(every) - F.sum("weight").over(filled) + F.col("weight")
    rows = rows.withColumn("level", (demand - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    target = F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return rows.select(
        F.col("source").alias("_llm_source"),
        "source_size",
        target.alias("target"),
        _cycle(F.col("rank"), tuple(a for a, _ in SCHEDULE)).alias("first_weight"),
        _cycle(F.col("rank"), tuple(b for _, b in SCHEDULE)).alias("last_weight"),
    )


def _time(offset: Column) -> Column:
    """Training time at which a source has used ``offset`` words: the inverse of the integral of its weight."""
    a, b, part = F.col("first_weight"), F.col("last_weight"), offset.cast("double") / F.col("target")
    bent = (F.sqrt(a * a + (b * b - a * a) * part) - a) / (b - a)
    return F.floor(F.when(a == b, part).otherwise(bent) * F.lit(float(TICKS))).cast("long")


def assign(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, taken per pass and training time per pass.

    ``rows`` and ``sizes`` are the same documents with doc_id, source, _llm_size and _llm_key; ``rows`` may have more.
    """
    targets = stored(source_targets(sizes), "mix-targets")
    piece = F.shiftright("_llm_key", 48).cast("int")
    sums = sizes.groupBy("source", piece.alias("piece")).agg(F.sum("_llm_size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("piece")) - F.col("sum")
    starts = sums.select(F.col("source").alias("_llm_of"), F.col("piece").alias("_llm_at"), before.alias("_llm_start"))
    inside = Window.partitionBy("source", "_llm_piece").orderBy("_llm_key", "doc_id", "_llm_size")
    running = F.sum("_llm_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_llm_size")
    rows = rows.withColumn("_llm_piece", piece).withColumn("_llm_running", running)
    rows = rows.join(starts, rows.source.eqNullSafe(starts._llm_of) & (rows._llm_piece == starts._llm_at))
    rows = rows.join(targets, rows.source.eqNullSafe(targets._llm_source))
    goal = F.floor("target").cast("long")
    for k in range(CEILING):
        offset = F.col("_llm_start") + F.col("_llm_running") + F.col("source_size") * k
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_llm_size"), goal - offset))
        rows = rows.withColumn(f"_llm_taken_{k}", part).withColumn(f"_llm_time_{k}", F.when(part > 0, _time(offset)))
    return rows


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_llm_size": word_count(F.col("text")), "_llm_key": order_key(F.col("doc_id"))})


def curriculum(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the training times of the passes, sorted by the first time."""
    sizes = stored(_measured(docs).select("doc_id", "source", "_llm_size", "_llm_key"), "mix-sizes")
    return (
        assign(sizes, sizes)
        .select(
            "doc_id",
            F.col("_llm_size").alias("size"),
            "source_size",
            "target",
            sum(F.col(f"_llm_taken_{k}") for k in range(CEILING)).cast("long").alias("taken"),
            *(F.col(f"_llm_time_{k}").alias(f"time_{k + 1}") for k in range(CEILING)),
            "_llm_key",
        )
        .orderBy(F.col("time_1").asc_nulls_last(), "_llm_key")
        .drop("_llm_key")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order: a row for each pass that takes half of a document or more."""
    names = docs.columns
    docs = numbered_columns(docs, "doc_id", "source", "text")
    sizes = stored(_measured(docs).select("doc_id", "source", "_llm_size", "_llm_key"), "mix-sizes")
    rows = assign(_measured(docs), sizes)
    times = F.array_compact(
        F.array(
            *(
                F.when((F.col(f"_llm_taken_{k}") > 0) & (F.col(f"_llm_taken_{k}") * 2 >= F.col("_llm_size")), F.col(f"_llm_time_{k}"))
                for k in range(CEILING)
            )
        )
    )
    # Written before the range sort, so the shuffle for the running sums goes first and the sort samples the table.
    timed = stored(rows.select(*docs.columns, "_llm_key", times.alias("_llm_times")).filter("size(_llm_times) > 0"), "mix-documents")
    passes = timed.select(*docs.columns, "_llm_key", F.explode("_llm_times").alias("_llm_time"))
    return passes.orderBy("_llm_time", "_llm_key").select(*docs.columns).toDF(*names)
