"""Run registered queries next to their SQL: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import registered

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = registered(), oracle_sql(), connect(folder)
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            got = df.collect()
            took = time.time() - began
            if name not in sql:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            columns = [c[0] for c in cur.description]
            want = cur.fetchall()
            types = {c[0]: str(c[1]) for c in cur.description}
            a, b = rows_of(df.columns, got), rows_of(columns, want)
            alike = {c: TYPES.get(t, t) for c, t in df.dtypes} == types
            same = alike and a == b
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(a)} / {len(b)} rows, {took:.1f}s", flush=True)
            if not same:
                print("   spark ", df.dtypes, "\n   duckdb", types)
                left, right = set(a) - set(b), set(b) - set(a)
                print("   only spark", list(left)[:3], "\n   only duckdb", list(right)[:3])
            elif len(names) == 1:
                print("   spark ", df.dtypes, "\n   duckdb", types)
        except Exception as error:  # keep going: this is a report
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print("not equal:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
