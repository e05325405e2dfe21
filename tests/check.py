"""Run queries beside their SQL and report what differs.

    python -m tests.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sorted_rows(columns, rows):
    """Rows as tuples with columns by name, in one order."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in at) for row in rows]
    return [columns[i] for i in at], sorted(plain, key=repr)


def kind(type_name: str) -> str:
    name = type_name.lower()
    for prefix, known in (("timestamp", "timestamp"), ("varchar", "string"), ("decimal", "decimal")):
        if name.startswith(prefix):
            return known
    return {"integer": "int", "hugeint": "hugeint", "float": "float"}.get(name, name)


def compare(spark, connection, sf_dir: str, build, sql: str) -> str | None:
    """What differs, or None."""
    frame = build(spark, sf_dir)
    got_columns, got = sorted_rows(frame.columns, frame.collect())
    result = connection.execute(sql)
    types = {d[0]: kind(str(d[1])) for d in result.description}
    want_columns, want = sorted_rows(list(types), result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    ours = {f.name: kind(f.dataType.simpleString()) for f in frame.schema}
    if ours != types:
        return f"types {[(c, ours[c], types[c]) for c in ours if ours[c] != types[c]]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    if differing:
        return f"{len(differing)} of {len(got)} rows differ, first {differing[0]}"
    return None


def local_session(plain: bool = False):
    from pyspark.sql import SparkSession

    if plain:
        return SparkSession.builder.master("local[8]").getOrCreate()
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default=SF)
    parser.add_argument("--plain", action="store_true", help="a session with no settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, connection = local_session(args.plain), oracle_connection(args.sf)
    queries, sql = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in args.names or queries:
        began = time.time()
        try:
            if name in sql:
                found = compare(spark, connection, args.sf, queries[name], sql[name])
                note = found or "ok"
            else:
                rows = queries[name](spark, args.sf).collect()
                found, note = None, f"rows {len(rows)}: {rows[0] if rows else None}"
        except Exception as error:  # report every failure, then go on
            found = note = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'pass'} {name} {time.time() - began:.1f}s {note[:1500]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
