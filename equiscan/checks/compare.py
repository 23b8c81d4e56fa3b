"""Run a registered query in both engines and compare every value.

``python -m equiscan.checks.compare DIR [key ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from equiscan.checks.catalog import REGISTRY, oracle, spark_query

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(f"{float(value):.12g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def table(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def kinds(rows, columns) -> dict[str, set[str]]:
    return {c: {kind(r[i]) for r in rows} - {"null"} for i, c in enumerate(columns)}


def compare(spark: SparkSession, con, sf_dir: str, key: str) -> tuple[str, str]:
    df = spark_query(key)(spark, sf_dir)
    left_rows = [tuple(r) for r in df.collect()]
    sql = oracle(key)
    if sql is None:
        return "rows only", f"{len(left_rows)} rows"
    result = con.execute(sql)
    right_columns = [c[0] for c in result.description]
    right_rows = result.fetchall()
    if sorted(df.columns) != sorted(right_columns):
        return "COLUMNS", f"{sorted(set(df.columns) ^ set(right_columns))}"
    if len(left_rows) != len(right_rows):
        return "ROWS", f"{len(left_rows)} against {len(right_rows)}"
    left, right = table(left_rows, df.columns), table(right_rows, right_columns)
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        names = sorted(df.columns)
        a, b = bad[0]
        where = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return "VALUES", f"{len(bad)} of {len(left)} rows, first {where[:3]}"
    lk, rk = kinds(left_rows, df.columns), kinds(right_rows, right_columns)
    odd = {c: (lk[c], rk[c]) for c in lk if lk[c] and rk[c] and lk[c] != rk[c]}
    return ("TYPES", str(odd)) if odd else ("ok", f"{len(left)} rows")


def main() -> None:
    from equiscan.session import build_session

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark, con = build_session(), connect(sf_dir)
    failures = 0
    for key in keys:
        start = time.time()
        try:
            state, note = compare(spark, con, sf_dir, key)
        except Exception as error:
            state, note = "ERROR", f"{type(error).__name__}: {str(error)[:400]}"
        if state != "ok":
            failures += 1
        print(f"{state:10} {key:34} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{len(keys) - failures} of {len(keys)} match")


if __name__ == "__main__":
    main()
