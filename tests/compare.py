"""Run registered queries next to their SQL twins: ``python tests/compare.py [sf] [pattern ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    left = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = con.sql(sql)
    right = normalised(relation.columns, relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(left[1])} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from orepulse import spark_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    patterns = sys.argv[2:]
    spark = spark_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con, twins = connect(folder), entry.oracle_sql()
    good = bad = rows_only = 0
    for name, query in entry.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            if name in twins:
                problem = difference(frame, con, twins[name])
            else:
                problem, rows_only = (None if frame.count() > 0 else "no rows"), rows_only + 1
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        good, bad = good + (problem is None), bad + (problem is not None)
        if problem or patterns or time.time() - start > 3:
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{good} good, {bad} bad, {rows_only} without SQL")
