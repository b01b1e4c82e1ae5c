"""Totals, boards and distribution measures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import lookups
from ledgerloom.operators.onerow import attach


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _is_over() -> Column:
    return F.coalesce("actual", F.lit(0)) > F.coalesce("budget", F.lit(0))


def budget_summary(budgets: DataFrame, year: int | None = None) -> DataFrame:
    """Budget, actual and variance by department, for one year or for each."""
    rows = budgets.where(F.col("department") != "UNKNOWN")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return (
        rows.groupBy("year", "department")
        .agg(F.sum("budget").alias("budget"), F.sum("actual").alias("actual"))
        .withColumn("variance", F.col("actual") - F.col("budget"))
        .orderBy("year", "department")
    )


def kpi_board(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame,
              as_of: dt.date, year: int, days_ahead: int = 90) -> DataFrame:
    """One row of headline figures with the list of alerts they raise."""
    b = budget_summary(budgets, year).agg(
        _sum0("budget").alias("total_budget"),
        _sum0("actual").alias("total_actual"),
        F.count_if(F.col("variance") > 0).alias("departments_over_budget"),
    )
    i = lookups.overdue_rows(invoices, as_of).agg(
        F.count("*").alias("overdue_count"), _sum0("amount").alias("total_overdue_amount"))
    c = lookups.expiring_contracts(contracts, as_of, days_ahead).agg(
        F.count("*").alias("expiring_soon"), _sum0("annual_value").alias("total_annual_value"))
    board = attach(attach(b, i), c).withColumn("variance", F.col("total_actual") - F.col("total_budget"))
    alerts = F.array(
        F.when(F.col("departments_over_budget") > 0, "budget_overrun:warning"),
        F.when(F.col("overdue_count") > 0, "overdue_invoices:high"),
        F.when(F.col("expiring_soon") > 0, "expiring_contracts:medium"),
    )
    return board.withColumn("alerts", F.array_compact(alerts))


def vendor_quarter_totals(invoices: DataFrame, first_month: int = 1, last_month: int = 12,
                          n: int = 10) -> DataFrame:
    return (
        invoices.where(F.month("date").between(first_month, last_month))
        .groupBy("vendor")
        .agg(F.count("*").alias("invoice_count"), F.sum("amount").alias("total_amount"))
        .orderBy(F.desc("total_amount"), F.asc_nulls_last("vendor"))
        .limit(n)
    )


def dept_totals(budgets: DataFrame) -> DataFrame:
    """Totals per department; ``years_over`` counts distinct years, ``periods_over`` rows."""
    return budgets.groupBy("department").agg(
        _sum0("budget").alias("budget"),
        _sum0("actual").alias("actual"),
        (_sum0("actual") - _sum0("budget")).alias("variance"),
        F.count_if(_is_over()).alias("periods_over"),
        F.count_distinct(F.when(_is_over(), F.col("year"))).alias("years_over"),
    )


def health_snapshot(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame,
                    as_of: dt.date) -> DataFrame:
    b = budgets.agg(
        F.count_distinct("department").alias("departments"),
        F.count_distinct(F.when(_is_over(), F.col("department"))).alias("departments_over"),
        _sum0(F.when(_is_over(), F.col("actual") - F.col("budget"))).alias("total_overrun"),
    )
    i = lookups.overdue_rows(invoices, as_of).agg(
        F.count("*").alias("overdue_count"), _sum0("amount").alias("overdue_value"))
    days = F.col("days_until_expiry")
    c = lookups.contracts_raw(contracts, as_of).agg(
        F.count("*").alias("contracts"),
        F.count_if((days > 0) & (days <= 90)).alias("expiring_90"),
    )
    return attach(attach(b, i), c)


def persistent_overspend(budgets: DataFrame, min_periods: int = 2) -> DataFrame:
    return (
        budgets.where(_is_over())
        .groupBy("department")
        .agg(F.count("*").alias("periods_over"))
        .where(F.col("periods_over") >= min_periods)
        .orderBy(F.desc("periods_over"), "department")
    )


def budget_grouping_sets(budgets: DataFrame) -> DataFrame:
    """Grand total, by department and by category, in one pass over the rows."""
    over = F.when(F.col("actual") > F.col("budget"), F.col("actual") - F.col("budget"))
    d, c = F.col("department"), F.col("category")
    return (
        budgets.groupingSets([[], [d], [c]], d, c)
        .agg(
            F.grouping_id().cast("bigint").alias("g"),
            F.sum("budget").alias("budget"),
            F.sum("actual").alias("actual"),
            F.count(over).alias("overruns"),
            _sum0(over).alias("overrun_total"),
        )
        .withColumn("level", F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "department")
                    .otherwise("category"))
        .select("level", "department", "category", "budget", "actual", "overruns", "overrun_total")
    )


def invoice_vendor_rollup(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Overdue invoices per vendor, largest total first."""
    return (
        lookups.overdue_rows(invoices, as_of)
        .groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor"))
        .agg(
            F.count("*").alias("invoices"),
            F.sum("amount").alias("total_amount"),
            F.max("days_overdue").alias("max_days"),
            F.round(F.avg("days_overdue"), 0).cast("bigint").alias("avg_days"),
        )
        .orderBy(F.desc("total_amount"), "vendor")
    )


def score_histogram(recommendations: DataFrame) -> DataFrame:
    """Recommendation counts per category and score band, with those above 70."""
    s = F.col("priority_score")
    band = F.when(s <= 25, "0-25").when(s <= 50, "26-50").when(s <= 75, "51-75").otherwise("76-100")
    return recommendations.groupBy("category", band.alias("band")).agg(
        F.count("*").alias("n"), F.count_if(s > 70).alias("high_priority"))


def alert_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("severity").agg(F.count("*").alias("n"))


def budget_totals(budgets: DataFrame) -> DataFrame:
    """Company totals with the share of rows over and under budget."""
    return budgets.agg(
        _sum0("budget").alias("total_budget"),
        _sum0("actual").alias("total_actual"),
        F.count_if(F.col("actual") > F.col("budget")).alias("rows_over"),
        F.count_if(F.col("actual") < F.col("budget")).alias("rows_under"),
    ).select(
        "*",
        (F.col("total_actual") - F.col("total_budget")).alias("total_variance"),
        F.round(_ratio(F.col("total_actual") - F.col("total_budget"), F.col("total_budget")) * 100, 1)
        .alias("variance_percent"),
    )


def risk_context(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame,
                 as_of: dt.date) -> DataFrame:
    b = budgets.agg(
        F.count("*").alias("budget_rows"),
        F.count_if(_is_over()).alias("rows_over"),
        _sum0(F.when(_is_over(), F.col("actual") - F.col("budget"))).alias("total_overrun"),
    )
    late = lookups.overdue_rows(invoices, as_of)
    i = late.agg(F.count("*").alias("overdue_count"), _sum0("amount").alias("overdue_amount"),
                 F.max("days_overdue").alias("oldest_days"))
    days = F.col("days_until_expiry")
    c = lookups.contracts_raw(contracts, as_of).where((days > 0) & (days <= 90)).agg(
        F.count("*").alias("expiring_90"), _sum0("annual_value").alias("value_at_risk"))
    return attach(attach(b, i), c)


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n")
             for k, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seasonality(flows: DataFrame) -> DataFrame:
    """Month-of-year means, index against the mean of all rows, peak and trough.

    ``volatility`` is the sample deviation of net cash flow over all rows.
    """
    def mean(c: str) -> Column:
        return _ratio(F.sum(c), F.count(c))

    n = F.col("net_cashflow").cast("double")
    months = flows.groupBy("month").agg(
        F.round(mean("inflows"), 2).alias("avg_inflows"),
        F.round(mean("outflows"), 2).alias("avg_outflows"),
        F.round(mean("net_cashflow"), 2).alias("avg_net"),
    )
    # the first month wins a tie on either end
    ends = months.agg(
        F.max_by("month", F.struct(F.col("avg_net"), -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct(F.col("avg_net"), F.col("month"))).alias("trough_month"),
    )
    whole = flows.agg(F.avg(n).alias("annual_average"), F.stddev_samp(n).alias("volatility"))
    return attach(attach(months, whole), ends).select(
        "month", "avg_inflows", "avg_outflows", "avg_net",
        F.round(F.try_divide(F.col("avg_net"), F.col("annual_average")), 2).alias("seasonality_index"),
        "annual_average", "volatility", "peak_month", "trough_month",
    )


def cashflow_baseline(flows: DataFrame) -> DataFrame:
    i, o, n = (F.col(c).cast("double") for c in ("inflows", "outflows", "net_cashflow"))
    return flows.agg(
        F.avg(i).alias("avg_inflows"), F.avg(o).alias("avg_outflows"), F.avg(n).alias("avg_net"),
        F.stddev_samp(i).alias("std_inflows"), F.stddev_samp(o).alias("std_outflows"),
        F.stddev_samp(n).alias("std_net"))


def dept_baseline(budgets: DataFrame) -> DataFrame:
    """Mean budget and actual per department, spread of the variance over mean budget.

    Where there is no spread (one row) or no budget, the default 0.15 stands.
    """
    a, b = F.col("actual").cast("double"), F.col("budget").cast("double")
    spread = F.stddev_samp((F.col("actual") - F.col("budget")).cast("double"))
    return budgets.groupBy("department").agg(
        F.avg(b).alias("monthly_budget"), F.avg(a).alias("avg_actual"),
        F.coalesce(F.when(F.avg(b) > 0, spread / F.avg(b)), F.lit(0.15)).alias("variance"))


def weighted_dso(invoices: DataFrame) -> DataFrame:
    """Days from invoice to payment weighted by amount, per client."""
    delay = F.greatest(F.datediff("paid_date", "date"), F.lit(0))
    return invoices.where("paid_date IS NOT NULL").groupBy("client").agg(
        F.count("*").alias("paid_invoices"),
        _ratio(F.sum(F.col("amount") * delay), F.sum("amount")).alias("dso"))


def dept_overbudget_share(budgets: DataFrame) -> DataFrame:
    v = (F.col("actual") - F.col("budget")).cast("double")
    return budgets.groupBy("department").agg(
        F.avg(v).alias("mean_variance"), F.stddev_pop(v).alias("std_variance"),
        F.avg((v > 0).cast("double")).alias("share_over"))


def amount_anomalies(invoices: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Amounts beyond so many population deviations; needs more than three amounts."""
    x = F.col("amount").cast("double")
    used = invoices.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    stats = used.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return (
        attach(used, stats)
        .where((F.col("n") > 3) & (F.abs(x - F.col("mean")) > sigmas * F.col("std")))
        .select("invoice_id", F.lit("unusual_amount").alias("type"), "amount",
                F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))
    )
