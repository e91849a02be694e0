"""The registered queries: each operator on the driver tables, next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowrisk.plans.inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Inputs`` under ``name``; ``sql`` is the DuckDB statement to match."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from flowrisk.plans import (  # noqa: F401
        address_queries,
        baseline_queries,
        flow_queries,
        scenario_queries,
        stress_queries,
        structural_queries,
    )
