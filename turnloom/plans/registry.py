"""Named queries over the driver tables, each with its SQL form for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Filled by the modules of this package.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from turnloom.plans import axis_queries, ingest_queries, judge_queries, panel_queries, report_queries, table_queries, telemetry_queries, text_queries  # noqa: E402, F401
