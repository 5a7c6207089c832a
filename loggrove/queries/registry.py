"""Name -> (query, equivalent SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "parsing", "cleaning", "vocabulary", "block_level", "arrival_level", "labeling",
    "scoring", "early_warning", "retention", "models", "streams", "lineage", "views",
)


def query(sql: str | None = None, name: str | None = None):
    def register(function: Query) -> Query:
        key = name or function.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = function
        if sql is not None:
            _SQL[key] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"loggrove.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
