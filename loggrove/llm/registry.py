"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("exact", "warc", "mixing", "near", "decontam", "licences", "repeats", "secrets", "urls", "toxicity", "quality", "negatives", "resampling")


def query(sql: str | None = None):
    def register(function):
        if function.__name__ in _QUERIES:
            raise ValueError(f"query {function.__name__} is registered twice")
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"loggrove.llm.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
