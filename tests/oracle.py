"""Run a query on Spark and its SQL on DuckDB, and compare names, row counts and values.

Usage: python tests/oracle.py <scale folder> [query …]
"""

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


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, query, sql: str, sf_dir: str) -> tuple[str, int]:
    """("" when equal, else what differs; number of Spark rows)."""
    df = query(spark, sf_dir)
    left = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    right = _table([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(left[1])
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}", len(left[1])
    for a, b in zip(left[1], right[1]):
        if a != b:
            differing = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
            bad = sum(x != y for x, y in zip(left[1], right[1]))
            return f"{bad} rows differ, first {a[:2]}: {differing}", len(left[1])
    return "", len(left[1])


if __name__ == "__main__":
    from ledgerspark import build_session
    from queries import ORACLES, QUERIES

    folder, names = sys.argv[1], sys.argv[2:]
    session = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(folder)
    for name in names or QUERIES:
        begin = time.time()
        try:
            if name in ORACLES:
                message, rows = compare(session, duck, QUERIES[name], ORACLES[name], folder)
            else:
                message, rows = "", QUERIES[name](session, folder).count()
            kind = "sql " if name in ORACLES else "rows"
            print(f"{'ok  ' if not message else 'FAIL'} {kind} {name} rows={rows} {time.time() - begin:.1f}s {message[:1500]}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
