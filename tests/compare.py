"""Run named queries on Spark and their SQL on DuckDB, and compare all values.

    python -m tests.compare <sf folder> [name or prefix* ...]
"""

from __future__ import annotations

import fnmatch
import sys
import time

import duckdb

from trackloom.plans import all_queries
from trackloom.plans.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_rows(frame):
    return _ordered(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return _ordered([d[0] for d in cursor.description], cursor.fetchall())


def difference(frame, con, sql, some: bool = False) -> str | None:
    columns, rows = spark_rows(frame)
    if some and not rows:
        return "no rows"
    if sql is None:
        return None
    expected_columns, expected = duck_rows(con, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows, expected {len(expected)}"
    for got, want in zip(rows, expected):
        if repr(got) != repr(want):
            return f"row {got} != {want}"
    return None


def main(folder: str, patterns: list[str]) -> int:
    from trackloom import build_session

    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, declared in all_queries().items():
        if patterns and not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        begin = time.time()
        try:
            frame = declared.run(spark, folder)
            problem = difference(frame, con, declared.sql)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        mark = "FAIL " + problem if problem else ("ok" if declared.sql else "ran")
        print(f"{name:40s} {time.time() - begin:6.1f}s {mark}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
