"""Compare queries with their SQL twins in DuckDB."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, run, sql: str) -> tuple[str | None, int, float]:
    """What differs (None if nothing), the number of rows, and Spark's seconds."""
    start = time.time()
    df = run(spark, folder)
    mine = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    got = con.execute(sql)
    theirs = rows_by_name([c[0] for c in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}", len(mine[1]), took
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}", len(mine[1]), took
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"first difference in {mine[0]}:\n  {str(a)[:600]}\n  {str(b)[:600]}", len(mine[1]), took
    return None, len(mine[1]), took


if __name__ == "__main__":
    from textrec.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if name not in wanted if wanted else name not in oracle:
            continue
        try:
            problem, rows, took = compare(spark, con, folder, run, oracle[name])
        except Exception as error:
            problem, rows, took = f"{type(error).__name__}: {str(error)[:800]}", -1, 0.0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:34} {rows:8} rows {took:7.2f} s {problem or ''}", flush=True)
    print("failed:", bad)
