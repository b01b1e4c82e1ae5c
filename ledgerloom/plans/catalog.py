"""Registry of named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.entities import Tables

Plan = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, finance: bool = True):
    """Register a plan under ``name``.

    ``sql`` is the DuckDB twin. With ``finance`` it may use the finance views
    (``invoices``, ``contracts``, ...) and starts with SELECT or with further
    comma-led common table expressions.
    """

    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = plan.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            from ledgerloom.plans.twin_views import FINANCE_VIEWS

            ORACLES[name] = FINANCE_VIEWS + sql if finance else sql
        return plan

    return register
