"""Compare registered queries with their oracle statements: ``check_oracle.py [folder] [name...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def rows_by_name(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, connection, folder: str, name: str, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    mine = rows_by_name(df.columns, df.collect())
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_by_name(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if mine != theirs:
        extra = [r for r in mine if r not in theirs][:3]
        missing = [r for r in theirs if r not in mine][:3]
        return f"{len(mine)} rows, oracle {len(theirs)}; only mine {extra}; only oracle {missing}"
    return None if mine else "no rows"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, sql in entry.oracle_sql().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name, sql)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.1f}s)", flush=True)
    print("without oracle:", sorted(set(entry.queries()) - set(entry.oracle_sql())))
    return bad


if __name__ == "__main__":
    sys.exit(main())
