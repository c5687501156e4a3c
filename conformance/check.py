"""Compare every registered query with its SQL: ``python -m conformance.check [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from conformance.oracle import ORACLE
from conformance.queries import QUERIES
from evalspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the tables of a folder as views."""
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def spark_rows(frame: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(frame.columns)
    rows = frame.select(*names).collect()
    return names, Counter(tuple(_plain(value) for value in row) for row in rows)


def duckdb_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(row[at]) for at in order) for row in result.fetchall())
    return [names[at] for at in order], rows


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, db, failures = local_session(8), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            columns, found = spark_rows(QUERIES[name](spark, folder))
            spark_time = time.time() - start
            expected_columns, expected = duckdb_rows(db, ORACLE[name])
        except Exception as failure:
            failures += 1
            print(f"FAIL {name}: {type(failure).__name__}: {str(failure)[:1500]}")
            continue
        if columns != expected_columns or found != expected:
            failures += 1
            print(f"FAIL {name}: {columns} / {expected_columns}, {found.total()} / {expected.total()} rows")
            print("   only in spark :", list((found - expected).items())[:2])
            print("   only in duckdb:", list((expected - found).items())[:2])
        else:
            print(f"ok   {name}: {found.total()} rows, {spark_time:.2f} s")
    missing = set(QUERIES) ^ set(ORACLE)
    print(f"{len(names)} queries, {failures} failures; without a partner: {sorted(missing)}")
    return 1 if failures or missing else 0


if __name__ == "__main__":
    sys.exit(main())
