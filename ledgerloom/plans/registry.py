"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str = "", text: str | None = None):
    """Registers a function of (spark, sf_dir) under its name; text is DuckDB SQL over the views named."""

    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = sql(views, text)
        return f

    return register
