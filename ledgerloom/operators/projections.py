"""Deterministic projections of observed months under named scenarios.

Every projection is a row-wise formula: what a month adds up to since the start
depends only on the month, so the running totals are constants of the month
table and no ordered window (and no shuffle) is needed after the baselines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.wording import tenth
from ledgerloom.operators.onerow import attach

# Scenario and shock multipliers for inflows and outflows.
SCENARIOS = [("optimistic", 1.15, 0.95), ("base", 1.0, 1.0), ("pessimistic", 0.85, 1.10)]
SHOCKS = [("revenue_drop_30", 0.7, 1.0), ("revenue_drop_50", 0.5, 1.0), ("cost_spike_20", 1.0, 1.2),
          ("combined_crisis", 0.6, 1.15)]

# Revenue per unit of budget, by department; 1.0 for any other.
REVENUE_MULTIPLIERS = {"Marketing": 3.0, "Sales": 5.0, "IT": 0.5, "R&D": 10.0, "HR": 0.3, "Operations": 1.0}
IMMEDIATE = ["Sales", "Operations"]
GRADUAL = ["Marketing", "R&D"]

# Monthly what-if seasonality, January to December.
SEASONAL = [0.88, 0.91, 0.97, 1.02, 1.05, 0.98, 0.93, 0.95, 1.04, 1.08, 1.12, 1.24]


def _rows(names: list[str], rows: list[tuple]) -> Column:
    """A short constant table as one array to explode."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))


# --------------------------------------------------------------------- cash flow


def flow_baseline(flows: DataFrame, entity: list[str]) -> DataFrame:
    """Mean monthly inflow and outflow per entity."""

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.coalesce(c, F.lit(0))).cast("double"), F.count("*").cast("double"))

    return flows.groupBy(*entity).agg(mean("inflows").alias("avg_in"), mean("outflows").alias("avg_out"))


def _months(count: int, as_of_month: int) -> Column:
    """Month number, its seasonal factor and the factors added up to it."""
    rows, total = [], 0.0
    for m in range(1, count + 1):
        calendar = (as_of_month + m - 1) % 12 + 1
        factor = 1 + 0.2 * math.sin(2 * math.pi * calendar / 12)
        total += factor
        rows.append((m, factor, total))
    return _rows(["month", "season", "season_sum"], rows)


def project_cashflow(baseline: DataFrame, entity: list[str], months: int, as_of_month: int,
                     starting_balance: float = 100000.0, scenarios: list[tuple] = SCENARIOS) -> DataFrame:
    """Monthly flows and balances of every entity under every scenario."""
    grid = baseline.withColumn("s", _rows(["scenario", "in_mult", "out_mult"], scenarios)).withColumn(
        "m", _months(months, as_of_month))
    base_in = F.greatest(F.col("avg_in"), F.lit(0.0)) * F.col("s.in_mult")
    base_out = F.greatest(F.col("avg_out"), F.lit(0.0)) * F.col("s.out_mult")
    inflows = base_in * F.col("m.season")
    closing = starting_balance + base_in * F.col("m.season_sum") - base_out * F.col("m.month")
    return grid.select(
        *entity, F.col("s.scenario").alias("scenario"), F.col("m.month").alias("month"),
        F.round(closing - (inflows - base_out), 2).alias("starting_balance"),
        F.round(inflows, 2).alias("inflows"), F.round(base_out, 2).alias("outflows"),
        F.round(inflows - base_out, 2).alias("net_cashflow"), F.round(closing, 2).alias("ending_balance"))


def summarise_cashflow(projection: DataFrame, entity: list[str]) -> DataFrame:
    def total(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(28,2)")).cast("double").alias(f"total_{c}")

    return projection.groupBy(*entity, "scenario").agg(
        F.max_by("ending_balance", "month").alias("final_balance"),
        F.min("ending_balance").alias("min_balance"), F.max("ending_balance").alias("max_balance"),
        total("inflows"), total("outflows"), total("net_cashflow"),
        (F.min("ending_balance") < 0).alias("liquidity_crisis"))


def stress_cashflow(baseline: DataFrame, entity: list[str], as_of_month: int, starting_balance: float = 100000.0,
                    months: int = 6, shocks: list[tuple] = SHOCKS) -> DataFrame:
    """Whether and when the balance falls below zero, per entity and shock."""
    path = project_cashflow(baseline, entity, months, as_of_month, starting_balance, shocks)
    return path.groupBy(*entity, F.col("scenario").alias("shock")).agg(
        (F.min("ending_balance") >= 0).alias("survives"), F.min("ending_balance").alias("min_balance"),
        F.max_by("ending_balance", "month").alias("final_balance"),
        F.min(F.when(F.col("ending_balance") < 0, F.col("month"))).alias("months_until_crisis"))


def liquidity(baseline: DataFrame, delays: DataFrame, days_ahead: int = 90, include_delays: bool = True,
              starting_balance: float = 100000.0) -> DataFrame:
    """Balance expected in so many days from the mean month and the clients' mean delay."""
    delay = delays.agg(F.coalesce(F.avg("avg_delay_days"), F.lit(0.0)).alias("avg_delay"))
    both = attach(baseline, delay)
    paid_days = F.greatest(F.lit(0.0), days_ahead - F.col("avg_delay")) if include_delays else F.lit(float(days_ahead))
    figures = both.select(
        F.round(F.col("avg_in") / 30 * paid_days, 2).alias("expected_receivables"),
        F.round(F.col("avg_out") / 30 * days_ahead, 2).alias("expected_payables"))
    balance = starting_balance + F.col("expected_receivables") - F.col("expected_payables")
    out, payables = F.col("expected_balance"), F.col("expected_payables")
    risk = (F.when(out < 0, "CRITICAL").when(out < payables * 0.2, "HIGH")
            .when(out < payables * 0.5, "MEDIUM").otherwise("LOW"))
    return (
        figures.withColumn("expected_balance", F.round(balance, 2))
        .withColumn("liquidity_ratio", F.round(F.try_divide(out, payables), 4))
        .withColumn("risk_level", risk).withColumn("days_ahead", F.lit(days_ahead))
    )


# ------------------------------------------------------------------------ budget


def month_factor(department: Column, month: Column) -> Column:
    """How far a change works in a month: at once, along an S-curve, or in a line."""
    return (F.when(department.isin(IMMEDIATE), month["immediate"])
            .when(department.isin(GRADUAL), month["gradual"]).otherwise(month["linear"]))


def _ramps(months: int) -> Column:
    rows, sums = [], [0.0, 0.0, 0.0]
    for m in range(1, months + 1):
        p = m / months
        now = [min(1.0, 0.7 + p * 0.3), 1 / (1 + math.exp(-10 * (p - 0.5))), p]
        sums = [a + b for a, b in zip(sums, now)]
        rows.append((m, *now, *sums))
    return _rows(["month", "immediate", "gradual", "linear", "immediate_sum", "gradual_sum", "linear_sum"], rows)


def _multiplier(department: Column, table: dict[str, float]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(department == name, value) if out is None else out.when(department == name, value)
    return out.otherwise(1.0)


def project_budget_change(baseline: DataFrame, changes: list[float], months: int = 12,
                          confidence: float = 0.95) -> DataFrame:
    """Revenue, cost and return by month for every department and budget change.

    ``baseline`` has department, monthly_budget and variance.
    """
    z = 1.96 if confidence == 0.95 else 2.576
    dept, m = F.col("department"), F.col("m")
    grid = baseline.withColumn("change_percent", F.explode(F.array(*[F.lit(float(c)) for c in changes]))).withColumn(
        "m", _ramps(months))
    new_budget = F.col("monthly_budget") * (1 + F.col("change_percent") / 100)
    gain = (new_budget - F.col("monthly_budget")) * _multiplier(dept, REVENUE_MULTIPLIERS)
    summed = (F.when(dept.isin(IMMEDIATE), m["immediate_sum"]).when(dept.isin(GRADUAL), m["gradual_sum"])
              .otherwise(m["linear_sum"]))
    worked = grid.select(
        "department", "change_percent", m["month"].alias("month"), "variance",
        (gain * month_factor(dept, m)).alias("revenue"), new_budget.alias("cost"),
        (gain * summed).alias("cumulative_revenue"), (new_budget * m["month"]).alias("cumulative_costs"))
    roi = F.when(F.col("cumulative_costs") > 0,
                 (F.col("cumulative_revenue") - F.col("cumulative_costs")) / F.col("cumulative_costs")).otherwise(0.0)
    return worked.withColumn("raw", roi).select(
        "department", "change_percent", "month",
        *[F.round(c, 2).alias(c) for c in ("revenue", "cost", "cumulative_revenue", "cumulative_costs")],
        F.round("raw", 4).alias("roi"), F.round(F.col("raw") - z * F.col("variance"), 4).alias("roi_low"),
        F.round(F.col("raw") + z * F.col("variance"), 4).alias("roi_high"))


def compare_changes(projection: DataFrame, changes: list[float]) -> DataFrame:
    """Best and worst change per department by final return, with advice.

    The change listed first wins a tie.
    """
    order = F.array_position(F.array(*[F.lit(float(c)) for c in changes]), F.col("change_percent"))
    last = projection.groupBy("department", "change_percent").agg(F.max_by("roi", "month").alias("roi"))
    picked = last.groupBy("department").agg(
        F.max_by(F.struct("change_percent", "roi"), F.struct(F.col("roi"), -order)).alias("best"),
        F.min_by(F.struct("change_percent", "roi"), F.struct(F.col("roi"), order)).alias("worst"))
    change, pct = F.col("best.change_percent"), tenth(F.col("best.roi") * 100)
    size = F.round(F.abs(change), 0).cast("bigint").cast("string")
    advice = (
        F.when(change > 0, F.concat(F.lit("Recommend increasing budget by "), size, F.lit("% for expected ROI of "), pct, F.lit("%")))
        .when(change < 0, F.concat(F.lit("Recommend decreasing budget by "), size, F.lit("% (ROI: "), pct, F.lit("%)")))
        .otherwise(F.concat(F.lit("Recommend maintaining current budget (ROI: "), pct, F.lit("%)")))
    )
    return picked.select("department", change.alias("best_change"), F.col("best.roi").alias("best_roi"),
                         F.col("worst.change_percent").alias("worst_change"), F.col("worst.roi").alias("worst_roi"),
                         advice.alias("recommendation"))


def breakeven(investments: DataFrame, months: int = 24) -> DataFrame:
    """First month whose returns add up to ``initial_investment``; null beyond ``months``."""
    need, gain = F.col("initial_investment"), F.col("monthly_return")
    month = F.when(gain >= need, F.lit(1).cast("bigint")).when(gain > 0, F.ceil(need / gain))
    return investments.withColumn("breakeven_month", F.when(month <= months, month))


def whatif_grid(base: DataFrame, settings: list[tuple]) -> DataFrame:
    """Budget per month, in thousands, under (cut, inflation, growth) percentages.

    ``base`` has department and monthly_budget.
    """
    months = _rows(["month", "season"], [(i + 1, s) for i, s in enumerate(SEASONAL)])
    grid = base.withColumn("p", _rows(["cut", "inflation", "growth"], settings)).withColumn("m", months)
    month, baseline = F.col("m.month"), F.col("monthly_budget") * F.col("m.season")

    def grown(rate: str) -> Column:
        return F.pow(1 + F.col(rate) / 100, month / 12)

    kept = 1 - F.col("p.cut") / 100

    def thousands(c: Column) -> Column:
        return F.floor(c / 1000 + 0.5).cast("bigint")

    return grid.select(
        "department", F.col("p.cut").alias("budget_cut"), F.col("p.inflation").alias("inflation"),
        F.col("p.growth").alias("growth"), month.alias("month"),
        thousands(baseline).alias("baseline"), thousands(baseline * kept).alias("with_cuts"),
        thousands(baseline * grown("p.inflation")).alias("with_inflation"),
        thousands(baseline * kept * grown("p.growth") * 0.97).alias("optimized"))
