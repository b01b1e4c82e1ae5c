"""Lookups and totals (who is late, what expires, who is over budget)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import lookups, metrics
from ledgerloom.plans.catalog import query
from ledgerloom.plans.edge import edge
from ledgerloom.plans.entities import AS_OF


@query("budget_summary", """
SELECT year::BIGINT AS year, department, sum(budget)::DOUBLE AS budget, sum(actual)::DOUBLE AS actual,
       (sum(actual) - sum(budget))::DOUBLE AS variance
FROM budgets WHERE department <> 'UNKNOWN' GROUP BY year, department""")
def _(t):
    return edge(metrics.budget_summary(t.budgets()))


@query("invoice_lookup", """
SELECT invoice_id, date, vendor, amount::DOUBLE AS amount, status FROM invoices
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    """The invoices a list of ids asks for: those with a returned line."""
    wanted = t.read("lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string")).alias("invoice_id"))
    return edge(lookups.invoice_lookup(t.invoices(client=False, paid=False), wanted))


@query("overdue_invoices", """
SELECT invoice_id, date, vendor, amount::DOUBLE AS amount, status,
       (DATE '2001-08-15' - due_date)::BIGINT AS days_overdue
FROM invoices WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15'""")
def _(t):
    return edge(lookups.overdue_invoices(t.invoices(client=False, paid=False), AS_OF))


@query("expiring_contracts", """
SELECT contract_id, vendor, end_date, annual_value::DOUBLE AS annual_value, auto_renewal,
       (end_date - DATE '2001-08-15')::BIGINT AS days_until_expiry
FROM contracts WHERE end_date > DATE '2001-08-15' AND end_date <= DATE '2001-08-15' + 90""")
def _(t):
    return edge(lookups.expiring_contracts(t.contracts(), AS_OF))


@query("contracts_all", """
SELECT contract_id, vendor, end_date, annual_value::DOUBLE AS annual_value, auto_renewal,
       coalesce(end_date - DATE '2001-08-15', 9999)::BIGINT AS days_until_expiry FROM contracts""")
def _(t):
    return edge(lookups.contracts_all(t.contracts(), AS_OF))


@query("invoices_raw", """
SELECT invoice_id, vendor, amount::DOUBLE AS amount, status,
       least(coalesce(DATE '2001-08-15' - due_date, 0), 365)::BIGINT AS days_overdue FROM invoices""")
def _(t):
    return edge(lookups.invoices_raw(t.invoices(client=False, paid=False), AS_OF))


@query("contracts_raw", """
SELECT contract_id, vendor, annual_value::DOUBLE AS annual_value,
       coalesce(end_date - DATE '2001-08-15', 999)::BIGINT AS days_until_expiry FROM contracts""")
def _(t):
    return edge(lookups.contracts_raw(t.contracts(), AS_OF))


@query("budgets_raw", """
SELECT department, year::BIGINT AS year, category, budget::DOUBLE AS budget, actual::DOUBLE AS actual,
       (actual - budget)::DOUBLE AS variance FROM budgets""")
def _(t):
    return edge(t.budgets().withColumn("variance", F.col("actual") - F.col("budget")))


@query("contract_clauses", """
SELECT contract_id, type, description, count(*) OVER (PARTITION BY contract_id)::BIGINT AS total_clauses
FROM clauses""")
def _(t):
    return edge(lookups.contract_clauses(t.clauses()))


@query("budget_variance", """
SELECT department, year::BIGINT AS year, category, budget::DOUBLE AS budget, actual::DOUBLE AS actual,
       (actual - budget)::DOUBLE AS variance,
       round((actual - budget)::DOUBLE / budget::DOUBLE * 100, 4) AS variance_percent FROM budgets""")
def _(t):
    return edge(lookups.budget_variance(t.budgets()))


@query("budget_overruns", """
SELECT department, year::BIGINT AS year, category, (actual - budget)::DOUBLE AS overrun
FROM budgets WHERE actual > budget""")
def _(t):
    return edge(lookups.budget_overruns(t.budgets()))


@query("contract_search", """
SELECT contract_id, vendor, annual_value::DOUBLE AS annual_value FROM contracts
WHERE contains(lower(vendor), 'supplier#00000') OR contains(lower(contract_id), 'supplier#00000')""")
def _(t):
    return edge(lookups.contract_search(t.contracts(), "SUPPLIER#00000"))


@query("contract_bands", """
, d AS (SELECT annual_value, coalesce(end_date - DATE '2001-08-15', 9999) AS d FROM contracts)
SELECT 'fixed' AS variant, CASE WHEN d <= 30 THEN 'critical' WHEN d <= 60 THEN 'warning' ELSE 'info' END AS band,
       count(*)::BIGINT AS contracts, sum(annual_value)::DOUBLE AS total_value FROM d GROUP BY 2
UNION ALL
SELECT 'window', CASE WHEN d <= 60 THEN 'critical' WHEN d <= 120 THEN 'warning' ELSE 'info' END,
       count(*)::BIGINT, sum(annual_value)::DOUBLE FROM d WHERE d BETWEEN 0 AND 180 GROUP BY 2""")
def _(t):
    fixed = lookups.contract_bands(t.contracts(), AS_OF)
    window = lookups.contract_bands(t.contracts(), AS_OF, window_days=180)
    return edge(fixed.withColumn("variant", F.lit("fixed")).unionByName(
        window.withColumn("variant", F.lit("window"))))


@query("invoice_urgency", """
, o AS (SELECT invoice_id, DATE '2001-08-15' - due_date AS d FROM invoices
        WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15')
SELECT invoice_id, d::BIGINT AS days_overdue,
       CASE WHEN d > 365 THEN 'critical' WHEN d > 180 THEN 'high' WHEN d > 60 THEN 'medium' ELSE 'low' END AS urgency
FROM o""")
def _(t):
    return edge(lookups.invoice_urgency(t.invoices(False, False, False), AS_OF))


@query("predictions_by_type", """
SELECT id, entity_type, entity_id, metric, predicted_value::DOUBLE AS predicted_value,
       actual_value::DOUBLE AS actual_value FROM predictions WHERE entity_type = 'budget'""")
def _(t):
    return edge(lookups.by_type(t.predictions(), "entity_type", "budget", [F.desc("id")]))


@query("top_overdue", """
SELECT invoice_id, vendor, amount::DOUBLE AS amount, (DATE '2001-08-15' - due_date)::BIGINT AS days_overdue
FROM invoices WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15'
ORDER BY amount DESC, invoice_id LIMIT 5""")
def _(t):
    return edge(lookups.top_overdue(t.invoices(client=False, paid=False), AS_OF))


@query("next_expiring", """
SELECT contract_id, vendor, annual_value::DOUBLE AS annual_value,
       (end_date - DATE '2001-08-15')::BIGINT AS days_until_expiry FROM contracts
WHERE end_date - DATE '2001-08-15' BETWEEN 1 AND 365 ORDER BY 4, contract_id LIMIT 8""")
def _(t):
    return edge(lookups.next_expiring(t.contracts(), AS_OF))


@query("kpi_board", """
, s AS (SELECT department, sum(budget) AS budget, sum(actual) AS actual FROM budgets
        WHERE department <> 'UNKNOWN' AND year = 2000 GROUP BY department),
b AS (SELECT coalesce(sum(budget), 0) AS tb, coalesce(sum(actual), 0) AS ta,
             count(*) FILTER (actual > budget) AS over FROM s),
i AS (SELECT count(*) AS n, coalesce(sum(amount), 0) AS v FROM invoices
      WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15'),
c AS (SELECT count(*) AS n, coalesce(sum(annual_value), 0) AS v FROM contracts
      WHERE end_date > DATE '2001-08-15' AND end_date <= DATE '2001-08-15' + 90)
SELECT tb::DOUBLE AS total_budget, ta::DOUBLE AS total_actual, (ta - tb)::DOUBLE AS variance,
       over::BIGINT AS departments_over_budget, i.n::BIGINT AS overdue_count,
       i.v::DOUBLE AS total_overdue_amount, c.n::BIGINT AS expiring_soon,
       c.v::DOUBLE AS total_annual_value,
       concat_ws(',', CASE WHEN over > 0 THEN 'budget_overrun:warning' END,
                 CASE WHEN i.n > 0 THEN 'overdue_invoices:high' END,
                 CASE WHEN c.n > 0 THEN 'expiring_contracts:medium' END) AS alerts
FROM b, i, c""")
def _(t):
    board = metrics.kpi_board(t.budgets(), t.invoices(False, False, False), t.contracts(), AS_OF, 2000)
    return edge(board.withColumn("alerts", F.array_join("alerts", ",")))


@query("vendor_quarter_totals", """
SELECT vendor, count(*)::BIGINT AS invoice_count, sum(amount)::DOUBLE AS total_amount FROM invoices
WHERE month(date) BETWEEN 1 AND 3 GROUP BY vendor ORDER BY sum(amount) DESC, vendor NULLS LAST LIMIT 10""")
def _(t):
    return edge(metrics.vendor_quarter_totals(t.invoices(client=False, paid=False), 1, 3))


@query("dept_totals", """
SELECT department, sum(budget)::DOUBLE AS budget, sum(actual)::DOUBLE AS actual,
       (sum(actual) - sum(budget))::DOUBLE AS variance, count(*) FILTER (actual > budget)::BIGINT AS periods_over,
       count(DISTINCT CASE WHEN actual > budget THEN year END)::BIGINT AS years_over
FROM budgets GROUP BY department""")
def _(t):
    return edge(metrics.dept_totals(t.budgets()))


@query("health_snapshot", """
, b AS (SELECT count(DISTINCT department) AS d, count(DISTINCT CASE WHEN actual > budget THEN department END) AS o,
               sum(CASE WHEN actual > budget THEN actual - budget END) AS t FROM budgets),
i AS (SELECT count(*) AS n, sum(amount) AS v FROM invoices WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15'),
c AS (SELECT count(*) AS n, count(*) FILTER (end_date - DATE '2001-08-15' BETWEEN 1 AND 90) AS e FROM contracts)
SELECT d::BIGINT AS departments, o::BIGINT AS departments_over, coalesce(t, 0)::DOUBLE AS total_overrun,
       i.n::BIGINT AS overdue_count, coalesce(i.v, 0)::DOUBLE AS overdue_value, c.n::BIGINT AS contracts,
       e::BIGINT AS expiring_90 FROM b, i, c""")
def _(t):
    return edge(metrics.health_snapshot(t.budgets(), t.invoices(False, False, False), t.contracts(), AS_OF))


@query("persistent_overspend", """
SELECT department, count(*)::BIGINT AS periods_over FROM budgets WHERE actual > budget
GROUP BY department HAVING count(*) >= 2""")
def _(t):
    return edge(metrics.persistent_overspend(t.budgets()))


@query("budget_grouping_sets", """
SELECT CASE WHEN grouping(department) = 1 AND grouping(category) = 1 THEN 'all'
            WHEN grouping(department) = 0 THEN 'department' ELSE 'category' END AS level,
       department, category, sum(budget)::DOUBLE AS budget, sum(actual)::DOUBLE AS actual,
       count(*) FILTER (actual > budget)::BIGINT AS overruns,
       coalesce(sum(CASE WHEN actual > budget THEN actual - budget END), 0)::DOUBLE AS overrun_total
FROM budgets GROUP BY GROUPING SETS ((), (department), (category))""")
def _(t):
    return edge(metrics.budget_grouping_sets(t.budgets()))


@query("invoice_vendor_rollup", """
SELECT coalesce(vendor, 'Unknown') AS vendor, count(*)::BIGINT AS invoices, sum(amount)::DOUBLE AS total_amount,
       max(DATE '2001-08-15' - due_date)::BIGINT AS max_days,
       round(avg(DATE '2001-08-15' - due_date), 0)::BIGINT AS avg_days
FROM invoices WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15' GROUP BY 1""")
def _(t):
    return edge(metrics.invoice_vendor_rollup(t.invoices(client=False, paid=False), AS_OF))


@query("budget_totals", """
SELECT sum(budget)::DOUBLE AS total_budget, sum(actual)::DOUBLE AS total_actual,
       count(*) FILTER (actual > budget)::BIGINT AS rows_over, count(*) FILTER (actual < budget)::BIGINT AS rows_under,
       (sum(actual) - sum(budget))::DOUBLE AS total_variance,
       round((sum(actual) - sum(budget))::DOUBLE / sum(budget)::DOUBLE * 100, 1) AS variance_percent FROM budgets""")
def _(t):
    return edge(metrics.budget_totals(t.budgets()))


@query("risk_context", """
, b AS (SELECT count(*) AS n, count(*) FILTER (actual > budget) AS o,
               sum(CASE WHEN actual > budget THEN actual - budget END) AS t FROM budgets),
i AS (SELECT count(*) AS n, sum(amount) AS v, max(DATE '2001-08-15' - due_date) AS m FROM invoices
      WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15'),
c AS (SELECT count(*) AS n, sum(annual_value) AS v FROM contracts WHERE end_date - DATE '2001-08-15' BETWEEN 1 AND 90)
SELECT b.n::BIGINT AS budget_rows, o::BIGINT AS rows_over, coalesce(t, 0)::DOUBLE AS total_overrun,
       i.n::BIGINT AS overdue_count, coalesce(i.v, 0)::DOUBLE AS overdue_amount, m::BIGINT AS oldest_days,
       c.n::BIGINT AS expiring_90, coalesce(c.v, 0)::DOUBLE AS value_at_risk FROM b, i, c""")
def _(t):
    return edge(metrics.risk_context(t.budgets(), t.invoices(False, False, False), t.contracts(), AS_OF))


@query("table_counts", """
SELECT 'Invoice' AS label, count(*)::BIGINT AS n FROM invoices UNION ALL
SELECT 'Contract', count(*) FROM contracts UNION ALL SELECT 'Clause', count(*) FROM clauses UNION ALL
SELECT 'Budget', count(*) FROM budgets UNION ALL SELECT 'Prediction', count(*) FROM predictions""")
def _(t):
    return metrics.table_counts({
        "Invoice": t.invoices(False, False, False), "Contract": t.contracts(), "Clause": t.clauses(),
        "Budget": t.budgets(), "Prediction": t.predictions()})


@query("seasonality", """
, m AS (SELECT month, round(sum(inflows)::DOUBLE / count(inflows), 2) AS i,
               round(sum(outflows)::DOUBLE / count(outflows), 2) AS o,
               round(sum(net_cashflow)::DOUBLE / count(net_cashflow), 2) AS n FROM monthly_flows GROUP BY month),
w AS (SELECT avg(net_cashflow::DOUBLE) AS a, stddev_samp(net_cashflow::DOUBLE) AS v FROM monthly_flows),
e AS (SELECT (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS p,
             (SELECT month FROM m ORDER BY n, month LIMIT 1) AS t)
SELECT month::BIGINT AS month, i AS avg_inflows, o AS avg_outflows, n AS avg_net, round(n / a, 2) AS seasonality_index,
       round(a, 2) AS annual_average, round(v, 2) AS volatility, p::BIGINT AS peak_month, t::BIGINT AS trough_month
FROM m, w, e""")
def _(t):
    return edge(metrics.seasonality(t.monthly_flows()), annual_average=2, volatility=2)


@query("cashflow_baseline", """
SELECT round(avg(inflows::DOUBLE), 2) AS avg_inflows, round(avg(outflows::DOUBLE), 2) AS avg_outflows,
       round(avg(net_cashflow::DOUBLE), 2) AS avg_net, round(stddev_samp(inflows::DOUBLE), 2) AS std_inflows,
       round(stddev_samp(outflows::DOUBLE), 2) AS std_outflows,
       round(stddev_samp(net_cashflow::DOUBLE), 2) AS std_net FROM monthly_flows""")
def _(t):
    return edge(metrics.cashflow_baseline(t.monthly_flows()), avg_inflows=2, avg_outflows=2, avg_net=2,
                std_inflows=2, std_outflows=2, std_net=2)


@query("dept_baseline", """
SELECT department, round(avg(budget::DOUBLE), 2) AS monthly_budget, round(avg(actual::DOUBLE), 2) AS avg_actual,
       round(coalesce(stddev_samp((actual - budget)::DOUBLE) / avg(budget::DOUBLE), 0.15), 4) AS variance
FROM budgets GROUP BY department""")
def _(t):
    return edge(metrics.dept_baseline(t.budgets()), monthly_budget=2, avg_actual=2, variance=4)


@query("weighted_dso", """
SELECT client, count(*)::BIGINT AS paid_invoices,
       round(sum(amount * greatest(paid_date - date, 0))::DOUBLE / sum(amount)::DOUBLE, 4) AS dso
FROM invoices WHERE paid_date IS NOT NULL GROUP BY client""")
def _(t):
    return edge(metrics.weighted_dso(t.invoices(vendor=False)), dso=4)


@query("dept_overbudget_share", """
SELECT department, round(avg((actual - budget)::DOUBLE), 2) AS mean_variance,
       round(stddev_pop((actual - budget)::DOUBLE), 2) AS std_variance,
       round(avg((actual > budget)::INT), 4) AS share_over FROM budgets GROUP BY department""")
def _(t):
    return edge(metrics.dept_overbudget_share(t.budgets()), mean_variance=2, std_variance=2, share_over=4)


@query("amount_anomalies", """
, x AS (SELECT concat('INV-', o_orderkey::VARCHAR) AS invoice_id, o_totalprice::DECIMAL(18,2)::DOUBLE AS v FROM orders),
q AS (SELECT count(*) AS n, avg(v) AS m, stddev_pop(v) AS d FROM x)
SELECT invoice_id, 'unusual_amount' AS type, v AS amount, round(m, 2) AS mean, round(d, 2) AS std
FROM x, q WHERE n > 3 AND abs(v - m) > 1.5 * d""")
def _(t):
    """Registered at 1.5 deviations: the given totals have no tail at three."""
    return edge(metrics.amount_anomalies(t.invoices(False, False, False), sigmas=1.5))
