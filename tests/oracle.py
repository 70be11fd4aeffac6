"""Compare registered queries with their SQL: ``python tests/oracle.py [folder] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        if math.isfinite(value) and value.is_integer() and abs(value) < 2**53:
            return str(int(value))
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def normal(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    """Empty when the rows agree, else the first difference."""
    df = query(spark, folder)
    got = normal(df.columns, df.collect())
    if sql is None:
        return "" if got[1] else "no rows"
    result = con.execute(sql)
    want = normal([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "no rows"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} != {len(want[1])}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"[:1500]
    return ""


def main() -> int:
    from gazette.registry import ORACLES, QUERIES
    from gazette.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
