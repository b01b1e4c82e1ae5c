"""Filters and projections over invoices, contracts, budgets and stored findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_EXPIRY_LISTING = 9999
NO_EXPIRY_RULES = 999
OVERDUE_CAP = 365


def days_overdue(as_of: dt.date) -> Column:
    return F.datediff(F.lit(as_of), F.col("due_date"))


def days_to_expiry(as_of: dt.date, missing: int) -> Column:
    return F.coalesce(F.datediff(F.col("end_date"), F.lit(as_of)), F.lit(missing))


def invoice_lookup(invoices: DataFrame, wanted: DataFrame | list[str]) -> DataFrame:
    """Invoices by id; ``wanted`` is a list of ids or a table with ``invoice_id``."""
    cols = ["invoice_id", "date", "vendor", "amount", "status"]
    if isinstance(wanted, DataFrame):
        return invoices.join(wanted.select("invoice_id"), "invoice_id", "left_semi").select(*cols)
    return invoices.where(F.col("invoice_id").isin(wanted)).select(*cols)


def overdue_invoices(invoices: DataFrame, as_of: dt.date, min_days: int = 0) -> DataFrame:
    """Unpaid invoices past their due date, days not capped, oldest first."""
    return (
        invoices.where((F.col("status") == "UNPAID") & (F.col("due_date") < F.lit(as_of)))
        .where(F.col("due_date") <= F.date_sub(F.lit(as_of), min_days))
        .select("invoice_id", "date", "vendor", "amount", "status",
                days_overdue(as_of).alias("days_overdue"))
        .orderBy(F.desc("days_overdue"), "invoice_id")
    )


def expiring_contracts(contracts: DataFrame, as_of: dt.date, days_ahead: int = 90) -> DataFrame:
    day = F.lit(as_of)
    return (
        contracts.where(F.col("end_date").between(F.date_add(day, 1), F.date_add(day, days_ahead)))
        .select("contract_id", "vendor", "end_date", "annual_value", "auto_renewal",
                F.datediff("end_date", day).alias("days_until_expiry"))
        .orderBy("days_until_expiry", "contract_id")
    )


def contracts_all(contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """Every contract; one without an end date sorts last with 9999 days."""
    return contracts.select(
        "contract_id", "vendor", "end_date", "annual_value", "auto_renewal",
        days_to_expiry(as_of, NO_EXPIRY_LISTING).alias("days_until_expiry"),
    ).orderBy("days_until_expiry", "contract_id")


def invoices_raw(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Rule input: any status, days capped at 365, negative when not yet due."""
    days = F.least(F.coalesce(days_overdue(as_of), F.lit(0)), F.lit(OVERDUE_CAP))
    return invoices.select("invoice_id", "vendor", "amount", "status", days.alias("days_overdue"))


def contracts_raw(contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """Rule input: 999 days where there is no end date. An expiry today stays 0."""
    return contracts.select("contract_id", "vendor", "annual_value",
                            days_to_expiry(as_of, NO_EXPIRY_RULES).alias("days_until_expiry"))


def contract_clauses(clauses: DataFrame, contract_id: str | None = None) -> DataFrame:
    """Clauses with the clause total of their contract, for one contract or all."""
    if contract_id is not None:
        clauses = clauses.where(F.col("contract_id") == contract_id)
    totals = clauses.groupBy("contract_id").agg(F.count("*").alias("total_clauses"))
    return (
        clauses.join(totals, "contract_id")
        .select("contract_id", "type", "description", "total_clauses")
        .orderBy("contract_id", "type")
    )


def budget_variance(budgets: DataFrame, department: str | None = None) -> DataFrame:
    """Variance of every (year, category) row of one department, or of all."""
    if department is not None:
        budgets = budgets.where(F.col("department") == department)
    gap = F.col("actual") - F.col("budget")
    pct = F.try_divide(gap.cast("double"), F.col("budget").cast("double")) * 100
    return budgets.select("department", "year", "category", "budget", "actual",
                          gap.alias("variance"), F.round(pct, 4).alias("variance_percent"))


def budget_overruns(budgets: DataFrame, year: int | None = None) -> DataFrame:
    if year is not None:
        budgets = budgets.where(F.col("year") == year)
    return (
        budgets.where(F.col("actual") > F.col("budget"))
        .select("department", "year", "category", (F.col("actual") - F.col("budget")).alias("overrun"))
        .orderBy(F.desc("overrun"), "department", "year", "category")
    )


def contract_search(contracts: DataFrame, text: str) -> DataFrame:
    """Contracts whose vendor or id holds the text, whatever the case."""
    needle = text.lower()
    return contracts.where(
        F.lower("vendor").contains(needle) | F.lower("contract_id").contains(needle)
    ).select("contract_id", "vendor", "annual_value")


def contract_bands(contracts: DataFrame, as_of: dt.date, window_days: int | None = None) -> DataFrame:
    """Count and value per expiry band.

    The bands end at 30 and 60 days; with ``window_days`` they are thirds of
    that window and later contracts fall out.
    """
    rows = contracts.select("annual_value", days_to_expiry(as_of, NO_EXPIRY_LISTING).alias("d"))
    first, second = (30, 60) if window_days is None else (window_days / 3, 2 * window_days / 3)
    if window_days is not None:
        rows = rows.where(F.col("d").between(0, window_days))
    band = F.when(F.col("d") <= first, "critical").when(F.col("d") <= second, "warning").otherwise("info")
    return rows.groupBy(band.alias("band")).agg(
        F.count("*").alias("contracts"), F.sum("annual_value").alias("total_value"))


def urgency(days: Column) -> Column:
    return (F.when(days > 365, "critical").when(days > 180, "high")
            .when(days > 60, "medium").otherwise("low"))


def invoice_urgency(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Overdue invoices with their urgency band."""
    return overdue_rows(invoices, as_of).withColumn("urgency", urgency(F.col("days_overdue"))).select(
        "invoice_id", "days_overdue", "urgency")


def overdue_rows(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Unordered form of :func:`overdue_invoices` for use below other operators."""
    return invoices.where(
        (F.col("status") == "UNPAID") & (F.col("due_date") < F.lit(as_of))
    ).withColumn("days_overdue", days_overdue(as_of))


def by_type(rows: DataFrame, type_column: str, wanted: str | None, order: list[Column]) -> DataFrame:
    """Stored findings, optionally of one type, in the given order."""
    if wanted is not None:
        rows = rows.where(F.col(type_column) == wanted)
    return rows.orderBy(*order)


def acknowledge(rows: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Set ``acknowledged`` on the named rows; the rest stay as they are."""
    if isinstance(ids, DataFrame):
        marked = ids.select("id").distinct().withColumn("hit", F.lit(True))
        return (
            rows.join(marked, "id", "left")
            .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("hit", F.lit(False)))
            .drop("hit")
        )
    return rows.withColumn("acknowledged", F.col("acknowledged") | F.col("id").isin(ids))


def top_overdue(invoices: DataFrame, as_of: dt.date, n: int = 5) -> DataFrame:
    return (
        overdue_rows(invoices, as_of)
        .select("invoice_id", "vendor", "amount", "days_overdue")
        .orderBy(F.desc("amount"), "invoice_id")
        .limit(n)
    )


def next_expiring(contracts: DataFrame, as_of: dt.date, within: int = 365, n: int = 8) -> DataFrame:
    return (
        contracts_raw(contracts, as_of)
        .where((F.col("days_until_expiry") > 0) & (F.col("days_until_expiry") <= within))
        .orderBy("days_until_expiry", "contract_id")
        .limit(n)
    )
