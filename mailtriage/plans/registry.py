"""Registry of named queries: ``name -> (spark callable, oracle SQL or None)``.

Each query takes ``(spark, sf_dir)``, reads the driver's tables (or views
derived from them) and returns a lazy DataFrame. The oracle SQL is the same
question in DuckDB SQL over the same tables; ``None`` marks operators that SQL
cannot express (model training, streaming state), checked by tests instead.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register ``fn`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if bench:
            BENCH.append(name)
        return fn
    return deco
