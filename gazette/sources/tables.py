"""Stored tables: versions, merge by link, dated snapshots, retention and exports.

A table is a folder of ``version=N`` folders. A version exists once its ``_SUCCESS`` marker does, which Spark
writes last, so readers see a whole version or none and a failed job changes nothing.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import col

_VERSION = re.compile(r"^version=(\d+)$")
_SNAPSHOT = re.compile(r"^(?:snapshot_date=)?(\d{4}-\d{2}-\d{2})$")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder (empty when it does not exist)."""
    path, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _committed(spark: SparkSession, folder: str) -> bool:
    path, fs = _path(spark, f"{folder}/_SUCCESS")
    return bool(fs.exists(path))


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    found = [int(m.group(1)) for m in map(_VERSION.match, list_names(spark, root)) if m]
    return sorted(v for v in found if _committed(spark, f"{root}/version={v}"))


def table_exists(spark: SparkSession, root: str) -> bool:
    return bool(versions(spark, root))


def read_table(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Newest version; an empty table of ``schema`` when there is none."""
    found = versions(spark, root)
    if found:
        return spark.read.parquet(f"{root}/version={found[-1]}")
    if schema is None:
        raise FileNotFoundError(root)
    return spark.createDataFrame([], schema)


def replace_table(df: DataFrame, root: str, *, keep_versions: int = 2) -> int:
    """Write the next version and drop all but the last ``keep_versions``; fails if another writer has begun it."""
    spark = df.sparkSession
    found = versions(spark, root)
    number = found[-1] + 1 if found else 1
    df.write.mode("error").parquet(f"{root}/version={number}")
    for old in (found + [number])[:-keep_versions]:
        delete_folder(spark, f"{root}/version={old}")
    return number


def require_key(df: DataFrame, key: str) -> DataFrame:
    """Fail the job that writes the rows when a key is NULL."""
    checked = F.when(col(key).isNull(), F.raise_error(F.lit(f"{key} is NULL"))).otherwise(col(key))
    return df.withColumn(key, checked)


def newest_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """First row per key in the given order; each task keeps one row per key before the shuffle."""
    window = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def merge_by_key(current: DataFrame, batch: DataFrame, *, key: str = "link", order: list[Column] | None = None) -> DataFrame:
    """Rows of ``current`` without those that ``batch`` replaces, and one row per key of ``batch``: the first in ``order``.

    ``current`` holds a key once, so it only meets the keys of the batch in an anti join: a batch small enough
    to be broadcast moves no row of the table.
    """
    checked = require_key(batch, key)
    latest = newest_per_key(checked, key, *order) if order else checked.dropDuplicates([key])
    kept = current.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def choose_table(papers: DataFrame | None, articles: DataFrame | None) -> DataFrame:
    """The papers if there are any, else the articles in the same shape."""
    if papers is not None and (articles is None or has_rows(papers)):
        return papers
    if articles is None:
        raise FileNotFoundError("neither papers nor articles")
    return articles


def write_snapshot(df: DataFrame, root: str, day: dt.date) -> str:
    folder = f"{root}/snapshot_date={day.isoformat()}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def write_snapshots(df: DataFrame, root: str, day: str) -> None:
    """One snapshot for each date in the column ``day``, all written by one job; snapshots of other days stay.

    Spark writes beside the snapshots; each finished day then gets its marker and takes its place by a rename. A day with
    very many rows is dealt over several tasks. Rows without a day belong to no snapshot.
    """
    spark, stage = df.sparkSession, f"{root}/_stage-{uuid.uuid4().hex}"
    dated = df.where(col(day).isNotNull()).withColumnRenamed(day, "snapshot_date")
    dated.hint("rebalance", "snapshot_date").write.partitionBy("snapshot_date").parquet(stage)
    for name in list_names(spark, stage):
        if _SNAPSHOT.match(name):
            marker, fs = _path(spark, f"{stage}/{name}/_SUCCESS")
            fs.create(marker).close()
            delete_folder(spark, f"{root}/{name}")
            fs.rename(marker.getParent(), _path(spark, f"{root}/{name}")[0])
    delete_folder(spark, stage)


def snapshot_days(spark: SparkSession, *roots: str) -> dict[dt.date, str]:
    """Committed snapshot folders by day; names that are no dates are passed over."""
    found: dict[dt.date, str] = {}
    for root in roots:
        for name in list_names(spark, root):
            match = _SNAPSHOT.match(name)
            if not match or not _committed(spark, f"{root}/{name}"):
                continue
            try:
                found.setdefault(dt.date.fromisoformat(match.group(1)), f"{root}/{name}")
            except ValueError:
                continue
    return found


def latest_snapshot(spark: SparkSession, *roots: str) -> DataFrame | None:
    found = snapshot_days(spark, *roots)
    return spark.read.parquet(found[max(found)]) if found else None


def read_with_fallback(spark: SparkSession, root: str, *snapshot_roots: str) -> DataFrame | None:
    """The table if it has rows, else the latest snapshot that has, else whichever of the two exists."""
    primary = read_table(spark, root) if table_exists(spark, root) else None
    if primary is not None and has_rows(primary):
        return primary
    snapshot = latest_snapshot(spark, *snapshot_roots)
    if snapshot is not None and has_rows(snapshot):
        return snapshot
    return primary if primary is not None else snapshot


def partition_ages(names: DataFrame, *, today: dt.date, keep_days: int, name: str = "name") -> DataFrame:
    """Dated folder names (``2024-01-31``) and reports (``x_20240131.html``) with ``day`` and ``expired``."""
    folder = F.when(col(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(name), "yyyy-MM-dd"))
    report = F.try_to_date(F.nullif(F.regexp_extract(name, r"_(\d{8})\.html$", 1), F.lit("")), "yyyyMMdd")
    day = F.coalesce(folder, report)
    cutoff = today - dt.timedelta(days=keep_days)
    return names.withColumn("day", day).withColumn("expired", F.coalesce(col("day") < F.lit(cutoff), F.lit(False)))


def drop_expired_folders(spark: SparkSession, root: str, *, today: dt.date, keep_days: int) -> int:
    """Delete the dated folders older than the limit; other names stay."""
    cutoff, removed = today - dt.timedelta(days=keep_days), 0
    for name in list_names(spark, root):
        match = re.match(r"^(?:\w+=)?(\d{4}-\d{2}-\d{2})$", name)
        try:
            expired = bool(match) and dt.date.fromisoformat(match.group(1)) < cutoff
        except ValueError:
            continue
        if expired:
            delete_folder(spark, f"{root}/{name}")
            removed += 1
    return removed


# Quotes are doubled and spaces at the ends of values stay.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON text."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    flat = [F.to_json(n).alias(n) if t in ("array", "map", "struct") else col(n) for n, t in kinds.items()]
    df.select(*flat).write.mode("overwrite").options(**_CSV).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, **_CSV).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
