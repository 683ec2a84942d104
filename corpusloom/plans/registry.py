"""Names, Spark callables and oracle SQL of the engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Query]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)


def load_all() -> None:
    """Imports the modules that register queries."""
    from . import audit_queries, gate_queries, join_queries, metric_queries, report_queries, select_queries, source_queries, text_queries  # noqa: F401
