"""The decorator that registers a query together with its DuckDB statement."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a callable(spark, sf_dir) under its own name; ``sql`` is its oracle, if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
