"""Scored recommendations: cut cost, limit risk, reuse surplus."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scoring import capped_share, recommendation_score
from ledgerloom.functions.wording import name_or, slug, tenth, whole
from ledgerloom.operators import lookups


def _rec(rows: DataFrame, category: str, id_: Column, title: Column, text: Column, score: Column,
         impact_eur: Column, confidence: Column, evidence: list[Column]) -> DataFrame:
    return rows.select(
        id_.alias("id"), F.lit(category).alias("category"), title.alias("title"), text.alias("description"),
        score.alias("priority_score"), F.round(impact_eur.cast("double"), 0).alias("expected_impact_eur"),
        confidence.cast("double").alias("confidence"), F.array(*evidence).alias("supporting_evidence"))


def _labelled(label: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"{label}: "), value, F.lit(unit))


def _budget_id(prefix: str) -> Column:
    return F.concat_ws("_", F.lit(prefix), "department", F.col("year").cast("string"), "category")


def cost_recommendations(budgets: DataFrame, patterns: DataFrame) -> DataFrame:
    gap = F.col("actual") - F.col("budget")
    pct = gap.cast("double") / F.col("budget").cast("double") * 100
    over = (budgets.where("budget > 0 AND actual > budget")
            .withColumn("gap", gap).withColumn("pct", pct).where("pct > 10"))
    text = F.concat(F.lit("Department is "), tenth(F.col("pct")), F.lit("% over budget ("), whole(F.col("gap")),
                    F.lit(" EUR). Implement spend controls and freeze discretionary purchases."))
    sure = F.lit(0.85)
    overruns = _rec(
        over, "cost_reduction", _budget_id("rec_cost"),
        F.concat(F.lit("Reduce spend in "), name_or("department"), F.lit(" department")), text,
        recommendation_score(capped_share(F.col("gap"), 500000), capped_share(F.col("pct"), 50), sure),
        F.col("gap").cast("double") * 0.5, sure,
        [_labelled("Budget", whole(F.col("budget")), " EUR"), _labelled("Actual", whole(F.col("actual")), " EUR"),
         _labelled("Overrun", tenth(F.col("pct")), "%")])
    conf = F.col("confidence")
    billed = patterns.where((F.col("type") == "vendor_overbilling") & (conf >= 0.6))
    renegotiate = _rec(
        billed, "cost_reduction", F.concat(F.lit("rec_overbilling_"), slug(F.col("subject"))),
        F.concat(F.lit("Renegotiate contract with "), "subject"), F.col("description"),
        recommendation_score(F.lit(0.5), F.lit(0.6), conf), F.lit(0.0), conf, [F.col("description")])
    return overruns.unionByName(renegotiate)


def risk_recommendations(contracts: DataFrame, invoices: DataFrame, clusters: DataFrame,
                         as_of: dt.date, include_paid: bool = False) -> DataFrame:
    left, vendor = F.col("days_until_expiry"), name_or("vendor")
    value = F.coalesce("annual_value", F.lit(0))
    c = (lookups.contracts_raw(contracts, as_of).where("days_until_expiry BETWEEN 1 AND 90")
         .withColumn("annual_value", value))
    sure = F.lit(0.95)
    renew = _rec(
        c, "risk_mitigation", F.concat(F.lit("rec_contract_"), "contract_id"),
        F.concat(F.lit("Renew contract: "), vendor),
        F.concat(F.lit("Contract with '"), vendor, F.lit("' (value: "), whole(F.col("annual_value")),
                 F.lit(" EUR/yr) expires in "), left.cast("string"),
                 F.lit(" days. Failure to renew risks service disruption.")),
        recommendation_score(capped_share(F.col("annual_value"), 500000), capped_share(90 - left, 90), sure),
        F.col("annual_value"), sure,
        [_labelled("Days until expiry", left.cast("string")),
         _labelled("Annual value", whole(F.col("annual_value")), " EUR")])

    if not include_paid:
        invoices = invoices.where("status = 'UNPAID'")
    i = lookups.invoices_raw(invoices.where(F.col("due_date") <= F.date_sub(F.lit(as_of), 30)), as_of)
    i = i.withColumn("amount", F.coalesce("amount", F.lit(0)))
    days, sure = F.col("days_overdue"), F.lit(0.90)
    resolve = _rec(
        i, "risk_mitigation", F.concat(F.lit("rec_invoice_"), "invoice_id"),
        F.concat(F.lit("Resolve overdue invoice: "), vendor),
        F.concat(F.lit("Invoice of "), whole(F.col("amount")), F.lit(" EUR from '"), vendor, F.lit("' is "),
                 days.cast("string"), F.lit(" days overdue. Escalate to prevent vendor relationship damage.")),
        recommendation_score(capped_share(F.col("amount"), 100000), capped_share(days, 120), sure),
        F.col("amount"), sure,
        [_labelled("Days overdue", days.cast("string")), _labelled("Amount", whole(F.col("amount")), " EUR")])

    worst = (clusters.where(~F.col("acknowledged"))
             .agg(F.count("*").alias("n"), F.max("score").alias("score")).where("n > 0"))
    n, score, sure = F.col("n").cast("string"), F.col("score"), F.lit(0.75)
    review = _rec(
        worst, "risk_mitigation", F.lit("rec_weaksignal_cluster"),
        F.lit("Financial stress cluster requires holistic review"),
        F.concat(n, F.lit(" correlated weak signal cluster(s) detected. "
                          "Combined score indicates elevated financial risk.")),
        recommendation_score(capped_share(score, 10), F.lit(0.7), sure), F.lit(0.0), sure,
        [_labelled("Active clusters", n), _labelled("Max stress score", score.cast("string"))])
    return renew.unionByName(resolve).unionByName(review)


def surplus_recommendations(budgets: DataFrame) -> DataFrame:
    """Rows at least 15 % under budget; four fifths of the surplus counts as reusable."""
    spare = F.col("budget") - F.col("actual")
    pct = spare.cast("double") / F.col("budget").cast("double") * 100
    rows = (budgets.where("budget > 0 AND actual < budget")
            .withColumn("spare", spare).withColumn("pct", pct).where("pct >= 15"))
    sure, dept = F.lit(0.80), name_or("department")
    return _rec(
        rows, "revenue_optimization", _budget_id("rec_reallocate"),
        F.concat(F.lit("Reallocate surplus from "), dept),
        F.concat(F.lit("Department '"), dept, F.lit("' is "), tenth(F.col("pct")), F.lit("% under budget ("),
                 whole(F.col("spare")), F.lit(" EUR available). Reallocate to high-growth areas.")),
        recommendation_score(capped_share(F.col("spare"), 300000), F.lit(0.4), sure),
        F.col("spare").cast("double") * 0.8, sure,
        [_labelled("Surplus", whole(F.col("spare")), " EUR"), _labelled("Under-budget", tenth(F.col("pct")), "%")])


def recommend(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame, patterns: DataFrame,
              clusters: DataFrame, as_of: dt.date, include_paid: bool = False) -> DataFrame:
    """Every recommendation, unordered; keep acknowledgements with ``keep_acknowledged``."""
    return (
        cost_recommendations(budgets, patterns)
        .unionByName(risk_recommendations(contracts, invoices, clusters, as_of, include_paid))
        .unionByName(surplus_recommendations(budgets))
        .withColumn("created_at", F.lit(as_of))
        .withColumn("acknowledged", F.lit(False))
    )


def keep_acknowledged(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh rows with the ``acknowledged`` flag their stored twin carried."""
    seen = stored.where("acknowledged").select("id").distinct()
    return lookups.acknowledge(fresh, seen)


def top_recommendations(recs: DataFrame, limit: int = 20) -> DataFrame:
    return recs.orderBy(F.desc("priority_score"), "id").limit(limit)


def recommendation_lines(recs: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), "category", F.lit("] "), "title", F.lit(" (priority: "),
                    whole(F.col("priority_score")), F.lit("/100, impact: "),
                    whole(F.col("expected_impact_eur")), F.lit(" EUR)"))
    return recs.select("priority_score", "id", line.alias("line"))
