"""Run registered queries next to their SQL and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from pavement.plans.bindings import BASE  # noqa: E402
from pavement.session import local_session  # noqa: E402


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v)  # strict: the sign of zero counts
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    a, b = canonical(spark_columns, spark_rows), canonical(sql_columns, sql_rows)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows != {len(b[1])}"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(wrong)} of {len(a[1])} rows differ, first {wrong[0]}" if wrong else None


# What a column type may be on each side; the driver compares schemas too.
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def check(spark, con, folder: str, name: str) -> tuple[str | None, float, float, int]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, took, 0.0, len(rows)
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    sql_rows = cur.fetchall()
    sql_took = time.time() - start
    diff = difference(df.columns, rows, columns, sql_rows)
    if diff is None:
        bad = [(c, t, types[c]) for c, t in df.dtypes if KINDS.get(t) != types[c]]
        diff = f"types {bad}" if bad else None
    return diff, took, sql_took, len(rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = database(folder)
    failed = 0
    for name in names:
        try:
            diff, took, sql_took, n = check(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            diff, took, sql_took, n = str(error)[:600], 0.0, 0.0, -1
        failed += diff is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {name:26s} rows={n:<7d} spark={took:6.2f}s sql={sql_took:6.2f}s"
              + (f"\n     {diff}" if diff else ""), flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
