"""Comparison of a Spark query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        # Whole numbers must be equal; only fractions may differ by rounding.
        same = all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x))) or (isinstance(y, float) and isinstance(x, int) and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b))
        assert same, (a, b)
