"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows (order-insensitive), with doubles compared after rounding.
"""
from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except ImportError:
        pass
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [cols[i] for i in order], rows


TIMES = {}


def compare(spark_df, con, sql):
    import time
    t0 = time.time()
    scols, srows = spark_rows(spark_df)
    t1 = time.time()
    dcols, drows = duck_rows(con, sql)
    TIMES["spark"], TIMES["duck"] = t1 - t0, time.time() - t1
    problems = []
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duck={dcols}")
    if len(srows) != len(drows):
        problems.append(f"row count differs: spark={len(srows)} duck={len(drows)}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
    if not problems and s_sorted != d_sorted:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
        problems.append(f"values differ, first: {diff}")
    return problems
