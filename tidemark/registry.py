"""All queries of the analytics library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import backtests, decisions, inventory, market, metrics, reports, rolling, streams

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (rolling, metrics, decisions, backtests, market, reports, streams, inventory)


def queries() -> dict[str, Query]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
