"""A stored table in parts by day and by hash of its key; a change writes only the parts that it touches.

- ``rows/version=N/day=D/bucket=B``: the rows of the parts that change N touched, whole;
- ``keys/version=N/bucket=B``: the day of each key, so that a row is found although its day has changed;
- ``manifest/version=N``: which version each part has, with its number of rows, written last;
- ``pending/version=N``: an appended batch, one row per key, which no part holds yet.

Small batches are appended and cost their own size. Readers merge what is pending, and the writer merges it into the parts
when it holds ``LAG`` times as many rows as they do, so all these merges together write little more than the rows once.

Readers take the parts that the newest finished manifest names; a change that fails leaves the table as it was. Rows
without any day lie under ``none``. Parts that the last ``KEEP`` manifests do not name are deleted.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions.text import col
from ..session import shared_folder
from .tables import delete_folder, list_names, newest_per_key, require_key

KEEP = 2
LAG = 4
_MANIFEST = "kind string, day string, bucket int, version int, n bigint, text string"
_KEYS = "day string, stamp timestamp, bucket int"


def event_time(df: DataFrame) -> Column:
    """Publication, else collection."""
    return F.coalesce(*[col(c) for c in ("published", "collected_at") if c in df.columns])


class PartedTable:
    """The table below a folder that all executors share. One writer at a time.

    ``buckets`` stays the same for the life of a table. A day with very many rows is ``buckets`` parts of several files.
    """

    def __init__(self, spark: SparkSession, root: str, *, key: str = "link", buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        #: Manifests do not change once they are written.
        self._known: dict[int, tuple[dict, StructType]] = {}
        #: Finished batches and their number of rows; they do not change either.
        self._counted: dict[int, int] = {}

    # Manifests

    def versions(self) -> list[int]:
        names = [re.fullmatch(r"version=(\d+)", n) for n in list_names(self.spark, f"{self.root}/manifest")]
        return sorted(int(m.group(1)) for m in names if m and "_SUCCESS" in list_names(self.spark, f"{self.root}/manifest/{m.group(0)}"))

    def exists(self) -> bool:
        return bool(self.versions() or self._pending())

    def _pending(self) -> list[int]:
        """The finished batches that the newest manifest does not hold, in order."""
        names = [re.fullmatch(r"version=(\d+)", n) for n in list_names(self.spark, f"{self.root}/pending")]
        numbers = sorted(int(m.group(1)) for m in names if m)
        if not numbers:
            return []
        found = self.versions()
        merged = self._merged(found[-1]) if found else 0
        return [n for n in numbers if n > merged and (n in self._counted or "_SUCCESS" in list_names(self.spark, f"{self.root}/pending/version={n}"))]

    def _merged(self, version: int) -> int:
        """The last batch that the parts of a version hold."""
        return self._manifest(version)[0].get(("pending", None, None), (0, None))[0]

    def _manifest(self, version: int) -> tuple[dict[tuple[str, str | None, int], tuple[int, int]], StructType]:
        """(kind, day, bucket) -> (version, rows), and the schema of the rows."""
        if version not in self._known:
            found = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/version={version}").collect()
            texts = [r.text for r in found if r.kind == "schema"]
            parts = {(r.kind, r.day, r.bucket): (r.version, r.n) for r in found if r.kind != "schema"}
            self._known[version] = parts, StructType.fromJson(json.loads(texts[0]))
        return self._known[version]

    def parts(self) -> dict[tuple[str, int], tuple[int, int]]:
        """(day, bucket) -> (version, rows) of the parts as they are, without what is pending."""
        found = self.versions()
        return {k[1:]: v for k, v in self._manifest(found[-1])[0].items() if k[0] == "rows"} if found else {}

    def _next(self) -> int:
        begun = [int(n[8:]) for kind in ("rows", "keys", "manifest", "pending") for n in list_names(self.spark, f"{self.root}/{kind}") if re.fullmatch(r"version=\d+", n)]
        return max(begun, default=0) + 1

    def _commit(self, number: int, parts: dict, schema: StructType) -> None:
        rows = [(*k, *v, None) for k, v in parts.items()] + [("schema", None, None, None, None, schema.json())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").json(f"{self.root}/manifest/version={number}")
        self._known[number] = parts, schema
        self._clean()

    def _clean(self) -> None:
        found = self.versions()
        named = {(k[0], v[0], k[1], k[2]) for n in found[-KEEP:] for k, v in self._manifest(n)[0].items()}
        before = {(k[0], v[0], k[1], k[2]) for n in found[:-KEEP] for k, v in self._manifest(n)[0].items()}
        for kind, version, day, bucket in before - named:
            if kind != "pending":
                delete_folder(self.spark, f"{self.root}/{self._folder(kind, version, day, bucket)}")
        held = min((self._merged(n) for n in found[-KEEP:]), default=0)
        for name in list_names(self.spark, f"{self.root}/pending") if held else []:
            if int(name[8:]) <= held:
                delete_folder(self.spark, f"{self.root}/pending/{name}")
        for n in found[:-KEEP]:
            delete_folder(self.spark, f"{self.root}/manifest/version={n}")

    @staticmethod
    def _folder(kind: str, version: int, day: str | None, bucket: int) -> str:
        return f"{kind}/version={version}/" + (f"day={day}/" if day else "") + f"bucket={bucket}"

    # Parts

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _day(self, df: DataFrame) -> Column:
        return F.coalesce(F.date_format(event_time(df), "yyyy-MM-dd"), F.lit("none"))

    def _read(self, kind: str, parts: Iterable[tuple[str | None, int, int]], schema: str | StructType) -> DataFrame:
        """Rows of some parts (day, bucket, version), with the columns ``day`` and ``bucket``."""
        paths = [f"{self.root}/{self._folder(kind, version, day, bucket)}" for day, bucket, version in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths).drop("version")

    def _rows(self, parts: dict, schema: StructType, wanted=None) -> DataFrame:
        full = StructType(list(schema.fields)).add("day", "string").add("bucket", "integer")
        some = [(k[1], k[2], v[0]) for k, v in parts.items() if k[0] == "rows" and (wanted is None or k[1:] in wanted)]
        return self._read("rows", some, full)

    def _key_days(self, parts: dict, schema: StructType, buckets: set[int]) -> DataFrame:
        kind = schema[self.key].dataType.simpleString()
        some = [(None, k[2], v[0]) for k, v in parts.items() if k[0] == "keys" and k[2] in buckets]
        return self._read("keys", some, f"{self.key} {kind}, {_KEYS}")

    def _write_rows(self, df: DataFrame, number: int) -> dict:
        """Write rows in parts; the parts with their number of rows."""
        place = f"{self.root}/rows/version={number}"
        # Ranges that end with the key, so that a large part fills several files.
        df.repartitionByRange("day", "bucket", self.key).write.mode("error").partitionBy("day", "bucket").parquet(place)
        if not self._folders(place):
            return {}
        counts = self.spark.read.schema("day string, bucket int").parquet(place).groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("n"))
        return {("rows", r.day, r.bucket): (number, r.n) for r in counts.collect()}

    def _write_keys(self, df: DataFrame, number: int) -> dict:
        place = f"{self.root}/keys/version={number}"
        df.repartition("bucket").write.mode("error").partitionBy("bucket").parquet(place)
        return {("keys", None, int(name[7:])): (number, None) for name in self._folders(place)}

    def _folders(self, place: str) -> list[str]:
        return [n for n in list_names(self.spark, place) if "=" in n]

    # Reading and changing

    def read(self, schema: str | None = None) -> DataFrame:
        """All rows; an empty table of ``schema`` where there is none yet."""
        found, pending = self.versions(), self._pending()
        if pending:
            parts, known = self._manifest(found[-1]) if found else ({}, None)
            latest = self._folded(pending)
            if known is None:
                return latest.drop("_stamp", "_resets", "day", "bucket")
            latest, _ = self._winning(latest, parts, known, set(range(self.buckets)))
            return self._replaced(self._rows(parts, known), latest).drop("day", "bucket")
        if found:
            return self._rows(*self._manifest(found[-1])).drop("day", "bucket")
        if schema is None:
            raise FileNotFoundError(self.root)
        return self.spark.createDataFrame([], schema)

    def _latest(self, batch: DataFrame, order: list[Column], stamp: str | None) -> DataFrame:
        """The first row of each key in ``order`` with its ``_stamp``."""
        when = col(stamp).cast("timestamp") if stamp else F.lit(None).cast("timestamp")
        return newest_per_key(require_key(batch, self.key), self.key, *order).withColumn("_stamp", when)

    def _batches(self, pending: list[int]) -> DataFrame:
        paths = [f"{self.root}/pending/version={n}" for n in pending]
        schema = self.spark.read.parquet(paths[-1]).schema
        full = StructType(list(schema.fields)).add("version", "integer")
        return self.spark.read.schema(full).option("basePath", f"{self.root}/pending").parquet(*paths)

    def _folded(self, pending: list[int]) -> DataFrame:
        """What batches that are merged one after the other leave of each key, and after how many rows without a stamp."""
        rows = self._batches(pending)
        # A row without a stamp replaces any before it; after it the latest stamp stays, of equal ones the last.
        resets = F.count_if(col("_stamp").isNull()).over(W.partitionBy(self.key).orderBy("version"))
        rows = rows.withColumn("_resets", resets)
        last = newest_per_key(rows, self.key, col("_resets").desc(), col("_stamp").desc_nulls_last(), col("version").desc())
        return last.drop("version").withColumns({"day": self._day(rows), "bucket": self._bucket()})

    def _winning(self, latest: DataFrame, parts: dict, schema: StructType, buckets: set[int]) -> tuple[DataFrame, DataFrame]:
        """The rows that replace or add to the stored ones, with their ``_day`` there, and the day of each stored key."""
        days = self._key_days(parts, schema, buckets)
        # Days that retention has dropped are still among the keys of buckets that no batch has touched since.
        live = [k[1] for k in parts if k[0] == "rows"]
        days = days.where(col("day").isin(live)) if live else days.limit(0)
        old = days.select(self.key, col("day").alias("_day"), col("stamp").alias("_old"))
        later = (col("_old") > col("_stamp")) & (col("_resets") == 0)
        return latest.join(old, self.key, "left").where(~F.coalesce(later, F.lit(False))), days

    def _replaced(self, stored: DataFrame, latest: DataFrame) -> DataFrame:
        kept = stored.join(latest.select(self.key), self.key, "left_anti")
        return kept.unionByName(latest.drop("_stamp", "_resets", "_day", "_old"), allowMissingColumns=True)

    def append(self, batch: DataFrame, *, order: list[Column], stamp: str | None = None) -> int:
        """The same change as :meth:`upsert`, merged on read and from time to time into the parts."""
        number, before = self._next(), self._pending()
        rows = self._latest(batch, order, stamp)
        kinds = [(f.name, f.dataType) for f in rows.schema.fields]
        if before and kinds != [(f.name, f.dataType) for f in self._batches(before[-1:]).drop("version").schema.fields]:
            # Batches of other columns are not read together.
            self.compact()
            number, before = self._next(), []
        place = f"{self.root}/pending/version={number}"
        rows.write.mode("error").parquet(place)
        for n in [n for n in [*before, number] if n not in self._counted]:
            self._counted[n] = self.spark.read.parquet(f"{self.root}/pending/version={n}").count()
        if sum(self._counted[n] for n in [*before, number]) >= LAG * sum(n for _, n in self.parts().values()):
            self.compact()
        return number

    def compact(self) -> None:
        """Merge what is pending into the parts."""
        pending = self._pending()
        if pending:
            latest = self._folded(pending)
            self._merge(latest, latest.drop("_stamp", "_resets", "day", "bucket").schema, pending[-1])

    def upsert(self, batch: DataFrame, *, order: list[Column], stamp: str | None = None) -> int:
        """Merge a batch by key; of several rows of a key the first in ``order`` counts.

        With ``stamp`` a stored row with a later one stays. Only the parts where a key of the batch lies, or comes to
        lie, are read and written; other rows of these parts meet the keys in an anti join.
        """
        self.compact()
        latest = self._latest(batch, order, stamp).withColumn("_resets", F.lit(0).cast("bigint"))
        return self._merge(latest.withColumns({"day": self._day(batch), "bucket": self._bucket()}), batch.schema)

    def _merge(self, latest: DataFrame, columns: StructType, merged: int | None = None) -> int:
        """Write the parts that rows (one per key) touch; ``merged`` is the last batch that they come from."""
        found, number = self.versions(), self._next()
        parts, schema = self._manifest(found[-1]) if found else ({}, columns)
        known = {f.name for f in schema.fields}
        schema = StructType(schema.fields + [f for f in columns.fields if f.name not in known])
        place = shared_folder(self.spark, "batch")
        latest.write.parquet(place)
        latest = self.spark.read.schema(latest.schema).parquet(place)
        buckets = {r[0] for r in latest.select("bucket").distinct().collect()}
        if not buckets and found and merged is None:
            return found[-1]
        latest, days = self._winning(latest, parts, schema, buckets)
        moved = latest.select(F.explode(F.array_distinct(F.array("day", F.coalesce("_day", "day")))).alias("day"), "bucket")
        touched = {(r.day, r.bucket) for r in moved.distinct().collect()}
        changed = self._write_rows(self._replaced(self._rows(parts, schema, touched), latest), number)
        staying = days.join(latest.select(self.key), self.key, "left_anti")
        keys = staying.unionByName(latest.select(self.key, "day", col("_stamp").alias("stamp"), "bucket"))
        # In the files of the keys the day is a column, as its part is the bucket alone.
        changed |= self._write_keys(keys, number)
        gone = {("rows", *t) for t in touched} | {("keys", None, b) for b in buckets}
        if merged is not None:
            changed[("pending", None, None)] = (merged, None)
        self._commit(number, {k: v for k, v in parts.items() if k not in gone} | changed, schema)
        return number

    def delete_older_than(self, *, as_of: dt.datetime, keep_days: int) -> int:
        """Drop rows by event time; returns how many. Days before the limit go whole, only the day it falls on is written anew."""
        self.compact()
        found, number = self.versions(), self._next()
        if not found:
            return 0
        cutoff = as_of - dt.timedelta(days=keep_days)
        edge = f"{cutoff:%Y-%m-%d}"
        parts, schema = self._manifest(found[-1])
        dropped = {k for k in parts if k[0] == "rows" and k[1] != "none" and k[1] <= edge}
        if not dropped:
            return 0
        at_edge = {k[1:] for k in dropped if k[1] == edge}
        changed = {}
        if at_edge:
            rows = self._rows(parts, schema, at_edge)
            changed = self._write_rows(rows.where(event_time(rows) >= F.lit(cutoff)), number)
        self._commit(number, {k: v for k, v in parts.items() if k not in dropped} | changed, schema)
        return sum(parts[k][1] for k in dropped) - sum(n for _, n in changed.values())
