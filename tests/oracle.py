"""Comparison of a Spark result with DuckDB's: columns by name, rows as multisets, floats to six digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def same(spark_df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(spark_df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(cell(r[c]) for c in order) for r in spark_df.collect())
    at = [names.index(c) for c in order]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in want)
