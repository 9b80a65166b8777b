"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import rounded

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, its doubles rounded, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import conditions, effects, expressions, factors, fields, links, matrices, places, populations, reports, runs, storage, streams, summaries, vectors  # noqa: F401  registers their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
