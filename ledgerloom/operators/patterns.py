"""Recurring-behaviour detectors. Each returns rows of one shared schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.wording import name_or, slug, tenth, whole
from ledgerloom.operators import lookups


def _pattern(rows: DataFrame, kind: str, subject: Column, text: Column, confidence: Column,
             evidence: Column, id_prefix: str | None = None, id_: Column | None = None) -> DataFrame:
    key = id_ if id_ is not None else F.concat(F.lit(f"{id_prefix}_"), slug(subject))
    return rows.select(
        key.alias("id"), F.lit(kind).alias("type"), subject.alias("subject"), text.alias("description"),
        F.round(confidence, 2).alias("confidence"), evidence.cast("bigint").alias("evidence_count"))


def vendor_overbilling(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """Vendors whose mean invoice is over 1.1 times their monthly contract value."""
    billed = (
        invoices.where("amount > 0 AND vendor IS NOT NULL").groupBy("vendor")
        .agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
        .where("n >= 2")
        .withColumn("mean", F.col("total") / F.col("n"))
    )
    agreed = contracts.groupBy("vendor").agg(
        (F.coalesce(F.sum("annual_value"), F.lit(0)).cast("double") / 12).alias("monthly"))
    hits = billed.join(agreed, "vendor").where("monthly > 0 AND mean > monthly * 1.10D")
    mean, monthly = F.col("mean"), F.col("monthly")
    text = F.concat(
        F.lit("Vendor '"), "vendor", F.lit("' average invoice ("), whole(mean),
        F.lit(" EUR) exceeds monthly contract value ("), whole(monthly),
        F.lit(" EUR) by "), tenth((mean / monthly - 1) * 100), F.lit("%."))
    return _pattern(hits, "vendor_overbilling", F.col("vendor"), text,
                    F.least(F.lit(0.95), 0.5 + F.col("n") * 0.05), F.col("n"), "vendor_overbilling")


def dept_overspend(budgets: DataFrame) -> DataFrame:
    """Departments with two or more rows over 1.05 times their budget."""
    a, b = F.col("actual").cast("double"), F.col("budget").cast("double")
    hits = (
        budgets.where((F.col("department") != "UNKNOWN") & (b != 0) & (a > b * 1.05))
        .groupBy("department")
        .agg(F.count("*").alias("k"), F.avg((a - b) / b * 100).alias("overrun"))
        .where("k >= 2")
    )
    text = F.concat(
        F.lit("Department '"), "department", F.lit("' overspent by an average of "), tenth(F.col("overrun")),
        F.lit("% across "), F.col("k").cast("string"), F.lit(" budget periods."))
    return _pattern(hits, "department_overspend", F.col("department"), text,
                    F.least(F.lit(0.95), 0.4 + F.col("k") * 0.15), F.col("k"), "dept_overspend")


def late_payment(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Vendors with two or more unpaid invoices, over 30 days late on average."""
    hits = (
        lookups.overdue_rows(invoices, as_of)
        .groupBy(name_or("vendor", "UNKNOWN").alias("vendor"))
        .agg(F.count("*").alias("n"),
             F.avg("days_overdue").alias("days"))
        .where("n >= 2 AND days > 30")
    )
    text = F.concat(
        F.lit("Vendor '"), "vendor", F.lit("' invoices are on average "), whole(F.col("days")),
        F.lit(" days overdue across "), F.col("n").cast("string"), F.lit(" unpaid invoices."))
    return _pattern(hits, "late_payment_pattern", F.col("vendor"), text,
                    F.least(F.lit(0.90), 0.4 + F.col("n") * 0.05), F.col("n"), "late_payment")


def spend_spike(budgets: DataFrame) -> DataFrame:
    """One row when three or more budget rows spend over 1.2 times the mean row."""
    actual = F.coalesce("actual", F.lit(0)).cast("double")
    totals = budgets.agg((F.sum(F.coalesce("actual", F.lit(0))).cast("double") / F.count("*")).alias("mean"))
    hits = (
        budgets.select(actual.alias("a")).where(F.col("a") > totals.scalar() * 1.2)
        .agg(F.count("*").alias("k"))
        .where("k >= 3")
    )
    text = F.concat(
        F.lit("Detected "), F.col("k").cast("string"),
        F.lit(" budget periods with spending >20% above average, suggesting seasonal expenditure spikes."))
    return _pattern(hits, "seasonal_spike", F.lit("All Departments"), text, F.lit(0.65), F.col("k"),
                    id_=F.lit("spend_spike"))


def detect_patterns(invoices: DataFrame, contracts: DataFrame, budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """All detectors, stamped; store the result with ``sinks.upsert`` on ``id``."""
    found = (
        vendor_overbilling(invoices, contracts)
        .unionByName(dept_overspend(budgets))
        .unionByName(late_payment(invoices, as_of))
        .unionByName(spend_spike(budgets))
    )
    return found.withColumn("acknowledged", F.lit(False)).withColumn("last_updated", F.lit(as_of))


def patterns_by_type(patterns: DataFrame, kind: str | None = None) -> DataFrame:
    return lookups.by_type(patterns, "type", kind, [F.desc("confidence"), F.asc("id")])


def pattern_lines(patterns: DataFrame, n: int = 8) -> DataFrame:
    """The top patterns as lines of text, most certain first."""
    line = F.concat(F.lit("["), F.upper("type"), F.lit(" | confidence="),
                    F.round(F.col("confidence") * 100, 0).cast("bigint").cast("string"),
                    F.lit("%] "), F.col("description"))
    return (
        patterns.orderBy(F.desc("confidence"), "id").limit(n)
        .select("id", line.alias("line"))
    )
