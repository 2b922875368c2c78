"""Runs registered queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str:
    """Empty when both agree in columns, types and rows, else what differs."""
    df = fn(spark, sf_dir)
    mine, theirs = df.collect(), con.execute(sql)
    columns = [c[0] for c in theirs.description]
    rows = theirs.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = _rows(df.columns, mine), _rows(columns, rows)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{x}\n  against {y}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from msgwarden.session import local_session

    sf_dir = sys.argv[1]
    spark, con = local_session("compare", "8"), connect(sf_dir)
    sql = entry.oracle_sql()
    wrong = 0
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = compare(spark, con, sf_dir, name, fn, sql[name]) if name in sql else (
                "" if fn(spark, sf_dir).collect() else "no rows"
            )
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        wrong += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.1f}s {found[:1800]}", flush=True)
    print("wrong:", wrong)
