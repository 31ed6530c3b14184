"""All registered queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("frame_queries", "vector_queries", "text_queries", "segment_queries", "fusion_queries", "evaluation_queries", "io_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"momentsift.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
