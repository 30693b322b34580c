"""The list of registered queries: a Spark function, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimscope.catalog.views import NUDGE, Tables, check_sql, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, staged: bool = False) -> Callable:
    """Register a function of the input tables; ``sql`` is the statement that checks it, if there is one.

    ``staged``: each common table expression of the statement is worked out once, however often it is named.
    """

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(function(Tables(spark, str(sf_dir))), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            text = check_sql(sql)
            CHECKS[name] = re.sub(r"\b(\w+) AS \((?=\s*SELECT\b)", r"\1 AS MATERIALIZED (", text) if staged else text
        return function

    return register


def r(expression: str, digits: int = 6) -> str:
    """SQL: a double rounded for comparison as ``tidy`` does, without negative zero."""
    return f"(ROUND(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0e0)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
