"""Runs a query and its oracle side by side and says how they differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{base}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def order(row):
    return tuple((v is not None, str(type(v).__name__), v if v is not None else 0) for v in row)


def difference(con: duckdb.DuckDBPyConnection, df, sql: str) -> str | None:
    """None where rows, column names, kinds and values agree exactly."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    cols = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=order)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    kinds = {c: ({type(r[i]) for r in ours} | {type(None)}, {type(r[i]) for r in theirs} | {type(None)}) for i, c in enumerate(cols)}
    bad = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if bad:
        return f"kinds {bad}"
    if odd:
        return f"{len(odd)} of {len(ours)} rows differ, columns {[c for i, c in enumerate(cols) if any(a[i] != b[i] for a, b in odd)]}, first {odd[0]}"
    return None
