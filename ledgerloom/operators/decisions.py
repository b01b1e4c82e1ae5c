"""Ranked decisions from budgets, invoices, contracts, patterns and clusters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scoring import capped_share, decision_score
from ledgerloom.functions.wording import name_or, tenth, whole
from ledgerloom.operators import lookups

PER_SOURCE = 5

# The advice given per source.
ADVICE = {
    "Budget": "Review discretionary spending and freeze non-critical purchases. "
              "Request variance explanation from department head.",
    "Invoice": "Contact vendor to resolve payment. Escalate to finance director if > 90 days.",
    "Contract": "Initiate renewal negotiations immediately. Benchmark against market rates before signing.",
    "Episodic Memory": "Review historical trend and take preventive action.",
    "Weak Signal": "Conduct holistic financial review. Cross-check all flagged entities with management.",
}


def _decision(rows: DataFrame, source: str, id_: Column, severity: Column, title: Column, text: Column,
              impact_eur: Column, impact: Column, urgency: Column) -> DataFrame:
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select(
        id_.alias("id"), F.lit(source).alias("source"), "severity", title.alias("title"),
        text.alias("description"), F.lit(ADVICE[source]).alias("recommended_action"),
        F.round(impact_eur.cast("double"), 2).alias("financial_impact_eur"),
        decision_score(F.col("severity"), impact, urgency).alias("priority_score"))


def budget_decisions(budgets: DataFrame) -> DataFrame:
    gap = F.col("actual") - F.col("budget")
    pct = gap.cast("double") / F.col("budget").cast("double") * 100
    rows = budgets.where("budget > 0 AND actual > budget").withColumn("gap", gap).withColumn("pct", pct)
    dept = name_or("department")
    text = F.concat(F.lit("Department '"), dept, F.lit("' actual spend ("), whole(F.col("actual")),
                    F.lit(" EUR) exceeds budget ("), whole(F.col("budget")), F.lit(" EUR) by "),
                    tenth(F.col("pct")), F.lit("%."))
    return _decision(
        rows, "Budget",
        F.concat_ws("_", F.lit("budget_overrun"), "department", F.col("year").cast("string"), "category"),
        F.when(F.col("pct") > 20, "critical").when(F.col("pct") > 5, "warning"),
        F.concat(F.lit("Budget overrun: "), dept), text, F.col("gap"),
        capped_share(F.col("gap"), 500000), F.lit(1.0))


def invoice_decisions(invoices: DataFrame, as_of: dt.date, include_paid: bool = False) -> DataFrame:
    if not include_paid:
        invoices = invoices.where("status = 'UNPAID'")
    rows = lookups.invoices_raw(invoices.where(F.col("due_date") <= F.date_sub(F.lit(as_of), 30)), as_of)
    rows = rows.withColumn("amount", F.coalesce("amount", F.lit(0)))
    days, vendor = F.col("days_overdue"), name_or("vendor")
    text = F.concat(F.lit("Invoice from '"), vendor, F.lit("' for "), whole(F.col("amount")),
                    F.lit(" EUR is "), days.cast("string"), F.lit(" days overdue."))
    return _decision(
        rows, "Invoice", F.concat(F.lit("overdue_invoice_"), "invoice_id"),
        F.when(days >= 60, "critical").when(days >= 30, "warning"),
        F.concat(F.lit("Overdue invoice: "), vendor), text, F.col("amount"),
        capped_share(F.col("amount"), 100000), 1 + F.least(days / 100, F.lit(1.0)))


def contract_decisions(contracts: DataFrame, as_of: dt.date) -> DataFrame:
    rows = lookups.contracts_raw(contracts, as_of).where("days_until_expiry BETWEEN 0 AND 90")
    rows = rows.withColumn("annual_value", F.coalesce("annual_value", F.lit(0)))
    days, vendor = F.col("days_until_expiry"), name_or("vendor")
    text = F.concat(F.lit("Contract with '"), vendor, F.lit("' (value: "), whole(F.col("annual_value")),
                    F.lit(" EUR/yr) expires in "), days.cast("string"), F.lit(" days."))
    return _decision(
        rows, "Contract", F.concat(F.lit("expiring_contract_"), "contract_id"),
        F.when(days <= 30, "critical").when(days <= 60, "warning").otherwise("info"),
        F.concat(F.lit("Contract expiring: "), vendor), text, F.col("annual_value"),
        capped_share(F.col("annual_value"), 500000), 1 + (90 - days) / 100)


def pattern_decisions(patterns: DataFrame) -> DataFrame:
    conf = F.col("confidence")
    return _decision(
        patterns.where(conf >= 0.6), "Episodic Memory", F.concat(F.lit("episodic_"), "id"),
        F.when(conf >= 0.75, "warning").otherwise("info"),
        F.concat(F.lit("Recurring pattern: "), "type", F.lit(" — "), "subject"), F.col("description"),
        F.lit(0.0), conf, F.lit(1.0))


def cluster_decisions(clusters: DataFrame) -> DataFrame:
    score = F.col("score")
    text = ("Multiple correlated weak signals indicate hidden financial stress. Individual signals "
            "are below alert threshold but combined score is high.")
    return _decision(
        clusters.where((score >= 4) & ~F.col("acknowledged")), "Weak Signal",
        F.concat(F.lit("weak_signal_"), "id"),
        F.when(score >= 7, "critical").otherwise("warning"),
        F.concat(F.lit("Financial stress cluster detected (score: "), score.cast("string"), F.lit(")")),
        F.lit(text), F.lit(0.0), capped_share(score, 10), F.lit(1.2))


def all_decisions(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame, patterns: DataFrame,
                  clusters: DataFrame, as_of: dt.date, include_paid: bool = False) -> DataFrame:
    return (
        invoice_decisions(invoices, as_of, include_paid)
        .unionByName(budget_decisions(budgets))
        .unionByName(contract_decisions(contracts, as_of))
        .unionByName(pattern_decisions(patterns))
        .unionByName(cluster_decisions(clusters))
    )


def rank_decisions(decisions: DataFrame, limit: int = 20, per_source: int = PER_SOURCE) -> DataFrame:
    """The top rows of each source, then the top of all.

    The rank limit is applied inside every task before the shuffle by source,
    so a source with most of the rows sends only ``per_source`` rows per task.
    """
    best = Window.partitionBy("source").orderBy(F.desc("priority_score"), "id")
    return (
        decisions.withColumn("rn", F.row_number().over(best))
        .where(F.col("rn") <= per_source)
        .drop("rn")
        .orderBy(F.desc("priority_score"), "id")
        .limit(limit)
    )


def alert_view(decisions: DataFrame) -> DataFrame:
    """Decisions as alerts: severity as type, impact or score as text."""
    impact = F.when(
        F.col("financial_impact_eur") > 0,
        F.concat(F.lit("Financial impact: "), whole(F.col("financial_impact_eur")), F.lit(" EUR")),
    ).otherwise(F.concat(F.lit("Priority score: "), whole(F.col("priority_score"))))
    kind = F.when(F.col("severity").isin("critical", "warning"), F.col("severity")).otherwise("info")
    return decisions.select(
        "id", kind.alias("type"), F.col("source").alias("category"), "title", "description",
        F.col("recommended_action").alias("recommendation"), impact.alias("impact"))


def decision_lines(decisions: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(" (score: "),
                    tenth(F.col("priority_score")), F.lit(", impact: "),
                    whole(F.col("financial_impact_eur")), F.lit(" EUR) — "), "recommended_action")
    return decisions.select("priority_score", "id", line.alias("line"))
