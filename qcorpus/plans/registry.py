"""Registry of the queries exposed through ``__spark_entry__``.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` and, when the
operator is expressible in SQL, the equivalent DuckDB statement over the
given tables (used as the correctness oracle).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Register a query under ``name``; ``ids`` lists the SURVEY operator ids
    it covers; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
