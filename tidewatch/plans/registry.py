"""Where queries are registered: name, Spark plan, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ["serving", "statistics", "ingestion", "analysis", "lifecycles", "runs", "feeds", "enrichments"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
