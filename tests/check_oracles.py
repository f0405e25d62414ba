"""Runs queries next to their DuckDB SQL: python tests/check_oracles.py SF_DIR [names...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def normalised(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(normalised(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark, connection, sf_dir: str, function, sql: str | None) -> str:
    """Empty text if equal, else what differs."""
    df = function(spark, sf_dir)
    actual = sorted_rows(df.columns, df.collect())
    if sql is None:
        return ""
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    expected = sorted_rows(columns, result.fetchall())
    if actual == expected:
        return "" if actual else "no rows"
    pairs = [(a, e) for a, e in zip(actual, expected) if a != e][:2]
    return f"{len(actual)} vs {len(expected)} rows, {pairs}"


def main() -> None:
    from pyspark.sql import SparkSession

    from lotframe.catalog import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = oracle_connection(sf_dir), []
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, connection, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{time.time() - began:6.1f}s {name} {'ok' if not problem else 'DIFFERS ' + problem[:1500]}", flush=True)
        failed += [name] if problem else []
    print(f"{len(names) - len(failed)} of {len(names)} equal; differing: {failed}")


if __name__ == "__main__":
    main()
