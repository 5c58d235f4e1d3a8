"""Compare every registered query with its SQL in DuckDB.

Usage: python tests/check_sql.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isinf(value):
            return str(value)
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)}", took
    rel = con.sql(sql)
    want, columns = rel.fetchall(), rel.columns
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {df.columns} != {columns}", took
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left == right:
        return f"ok {len(left)}", took
    diff = [(a, b) for a, b in zip(left, right) if a != b][:3]
    return f"DIFF {len(left)} vs {len(right)} rows, first {diff}", took


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    sqls = entry.oracle_sql()
    for key, function in entry.queries().items():
        if names and key not in names:
            continue
        try:
            result, seconds = compare(session, connection, directory, key, function, sqls.get(key))
        except Exception as exc:  # report and go on
            result, seconds = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", 0.0
        print(f"{key:24s} {seconds:6.2f}s {result}", flush=True)
