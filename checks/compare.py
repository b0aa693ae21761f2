"""Run registered queries in Spark and their SQL in DuckDB, and compare whole results.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import oracle_sql
from checks.queries import QUERIES
from checks.tables import TABLES


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return _sorted_rows(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    return _sorted_rows([column[0] for column in result.description], result.fetchall())


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle, failures = duckdb_tables(sf_dir), oracle_sql(), 0
    for name in names or QUERIES:
        started = time.time()
        columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
        seconds = time.time() - started
        verdict = "rows only"
        if name in oracle:
            expected_columns, expected = duckdb_rows(connection, oracle[name])
            same = (columns, rows) == (expected_columns, expected)
            verdict = "same" if same else "DIFFERENT"
            failures += not same
            if not same:
                print("  columns", columns, expected_columns)
                print("  spark ", [row for row in rows if row not in expected][:4])
                print("  duckdb", [row for row in expected if row not in rows][:4])
        print(f"{name:24s} {len(rows):5d} rows  {seconds:6.2f} s  {verdict}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
