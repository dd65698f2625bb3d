"""All registered queries of the library and, by the same name, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a (spark, sf_dir) function under a name, with its SQL where SQL can say it."""

    def put(function):
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return put


def _load() -> None:
    from . import align_queries, desk_queries, library_queries, more_queries, page_queries, plan_queries, reading_queries, record_queries, rule_queries, state_queries, structure_queries, tree_queries, verify_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
