"""Comparison of a query with its SQL, as the driver does it: columns by name, rows in any order."""

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.execute(f"create view {f[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def text(v: object) -> str:
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def table_of(columns: list[str], rows: list) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


def assert_same(spark, con, sf: str, f, sql: str) -> int:
    df = f(spark, sf)
    got = table_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = table_of(names, cur.fetchall())
    assert got == want
    return len(got)
