"""The table of registered queries and of the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklogs.plans.bridge import zoneless

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; its timestamps come out as UTC without a zone."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf_dir: zoneless(function(spark, sf_dir))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add
