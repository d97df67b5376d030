"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries on import.
FAMILIES = ("grouping", "relational", "timeline", "judging", "more", "matching")


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its oracle where SQL can express it."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"lodestrata.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
