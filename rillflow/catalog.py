"""Registry of the event, retrieval and store queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.operators import detection, folds, metrics, overviews, projections, retrieval, risk, rules, series, sessions, stores, structured, tools, traces, verdicts
from rillflow.sources import queries as sinks
from rillflow.streaming import queries as streams

MODULES = (sessions, stores, rules, risk, retrieval, detection, series, traces, overviews, verdicts, projections, tools, metrics, folds, structured, sinks, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the registered operator modules."""
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Their DuckDB SQL."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
