"""Runs a query and its SQL over the same tables and tells how they differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if columns, number of rows and values are the same."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    cols = sorted(names)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(normal(r[c]) for c in cols) for r in want), key=str)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(cols, *(got[0], want[0]), strict=True) if type(a) is not type(b)] if got else []
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[:3]}" if bad else f"types {types}" if types else ""
