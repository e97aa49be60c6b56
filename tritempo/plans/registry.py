"""Registry of named plans and their SQL counterparts.

Each plan reads the tables under a directory and returns a DataFrame. The SQL
states the same result for the same tables and is written from the definition
of the operator, not from the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with the SQL that gives the same rows."""

    def register(build: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"plan {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
