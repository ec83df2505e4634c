"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (int, str, bool)):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    found = con.execute(sql)
    theirs_names = [c[0] for c in found.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    rough = lambda r: tuple(str(round(x, 4) + 0.0) if isinstance(x, float) else str(x) for x in r)
    for a, b in zip(sorted(mine, key=rough), sorted(theirs, key=rough)):
        if not close(a, b):
            return f"{dict(zip(names, a))} against {dict(zip(names, b))}"
    return ""


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
