"""Relations, patterns, weak signals, decisions, recommendations and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import (decisions, feedback, links, lookups, metrics, patterns,
                                  recommendations, signals)
from ledgerloom.plans.catalog import query
from ledgerloom.plans.edge import edge
from ledgerloom.plans.entities import AS_OF, Tables

# ---------------------------------------------------------------- shared plans


def billed(t: Tables):
    return t.invoices(client=False, paid=False)


# Everything built on patterns reads invoices and budgets many times over, so
# these are written once per query, and so are the patterns found in them.


def kept_billed(t: Tables):
    return t.kept("billed", lambda: billed(t).select("invoice_id", "date", "due_date", "vendor", "amount", "status"))


def kept_budgets(t: Tables):
    return t.kept("budgets", t.budgets)


def found_patterns(t: Tables):
    return t.kept("patterns", lambda: patterns.detect_patterns(kept_billed(t), t.contracts(), kept_budgets(t), AS_OF))


def found_signals(t: Tables):
    return signals.weak_signals(kept_budgets(t), kept_billed(t), t.contracts(), found_patterns(t), AS_OF)


def found_cluster(t: Tables):
    return t.kept("cluster", lambda: signals.cluster(found_signals(t), AS_OF))


def ranked(t: Tables, limit: int = 20):
    rows = decisions.all_decisions(
        kept_budgets(t), kept_billed(t), t.contracts(), found_patterns(t), found_cluster(t), AS_OF)
    return decisions.rank_decisions(rows, limit)


def recommended(t: Tables):
    return recommendations.recommend(
        kept_budgets(t), kept_billed(t), t.contracts(), found_patterns(t), found_cluster(t), AS_OF)


def outcomes(t: Tables):
    """Reported actuals of every second known outcome: a first estimate at half the value, then the value itself.

    The other outcomes were stored by earlier reports.
    """
    known = t.predictions().where("actual_value IS NOT NULL AND crc32(id) % 2 = 0")
    half = known.select(F.col("id").alias("prediction_id"),
                        (F.col("actual_value") / 2).cast("decimal(18,2)").alias("actual_value"), F.lit(1).alias("seq"))
    full = known.select(F.col("id").alias("prediction_id"), "actual_value", F.lit(2).alias("seq"))
    return half.unionByName(full)


def resolved(t: Tables):
    return feedback.resolve(t.predictions(), outcomes(t))


# ------------------------------------------------------------------ SQL pieces


def whole(x: str) -> str:
    return f"format('{{:,}}', round({x}, 0)::BIGINT)"


def tenth(x: str) -> str:
    return f"round({x}, 1)::DECIMAL(18,1)::VARCHAR"


DAYS = "(DATE '2001-08-15' - due_date)"
LEFT = "(end_date - DATE '2001-08-15')"
OVER_PCT = "((actual - budget)::DOUBLE / budget::DOUBLE * 100)"

PATTERNS = f"""
, billed AS (SELECT vendor, count(*) AS n, sum(amount)::DOUBLE / count(*) AS mean FROM invoices
             WHERE amount > 0 AND vendor IS NOT NULL GROUP BY vendor HAVING count(*) >= 2),
agreed AS (SELECT vendor, sum(annual_value)::DOUBLE / 12 AS monthly FROM contracts GROUP BY vendor),
p1 AS (SELECT concat('vendor_overbilling_', replace(vendor, ' ', '_')) AS id, 'vendor_overbilling' AS type,
              vendor AS subject,
              concat('Vendor ''', vendor, ''' average invoice (', {whole('mean')},
                     ' EUR) exceeds monthly contract value (', {whole('monthly')}, ' EUR) by ',
                     {tenth('(mean / monthly - 1) * 100')}, '%.') AS description,
              round(least(0.95::DOUBLE, 0.5 + n * 0.05::DOUBLE), 2) AS confidence, n AS evidence_count
       FROM billed JOIN agreed USING (vendor) WHERE monthly > 0 AND mean > monthly * 1.10::DOUBLE),
d2 AS (SELECT department, count(*) AS k, avg({OVER_PCT}) AS overrun FROM budgets
       WHERE department <> 'UNKNOWN' AND budget <> 0 AND actual::DOUBLE > budget::DOUBLE * 1.05::DOUBLE
       GROUP BY department HAVING count(*) >= 2),
p2 AS (SELECT concat('dept_overspend_', replace(department, ' ', '_')) AS id, 'department_overspend' AS type,
              department AS subject,
              concat('Department ''', department, ''' overspent by an average of ', {tenth('overrun')},
                     '% across ', k::VARCHAR, ' budget periods.') AS description,
              round(least(0.95::DOUBLE, 0.4 + k * 0.15::DOUBLE), 2) AS confidence, k AS evidence_count FROM d2),
d3 AS (SELECT coalesce(vendor, 'UNKNOWN') AS vendor, count(*) AS n, avg({DAYS}) AS days FROM invoices
       WHERE status = 'UNPAID' AND due_date < DATE '2001-08-15' GROUP BY 1
       HAVING count(*) >= 2 AND avg({DAYS}) > 30),
p3 AS (SELECT concat('late_payment_', replace(vendor, ' ', '_')) AS id, 'late_payment_pattern' AS type,
              vendor AS subject,
              concat('Vendor ''', vendor, ''' invoices are on average ', {whole('days')},
                     ' days overdue across ', n::VARCHAR, ' unpaid invoices.') AS description,
              round(least(0.90::DOUBLE, 0.4 + n * 0.05::DOUBLE), 2) AS confidence, n AS evidence_count FROM d3),
d4 AS (SELECT count(*) AS k FROM budgets
       WHERE actual::DOUBLE > (SELECT sum(actual)::DOUBLE / count(*) FROM budgets) * 1.2::DOUBLE HAVING count(*) >= 3),
p4 AS (SELECT 'spend_spike' AS id, 'seasonal_spike' AS type, 'All Departments' AS subject,
              concat('Detected ', k::VARCHAR, ' budget periods with spending >20% above average, ',
                     'suggesting seasonal expenditure spikes.') AS description,
              0.65::DOUBLE AS confidence, k AS evidence_count FROM d4),
patterns AS (SELECT *, false AS acknowledged, DATE '2001-08-15' AS last_updated
             FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4))
"""
PATTERN_COLUMNS = ("id, type, subject, description, confidence::DOUBLE AS confidence, "
                   "evidence_count::BIGINT AS evidence_count")

SIGNALS = PATTERNS + f"""
, signals AS (
SELECT 'budget_slightly_over' AS type, department AS subject,
       concat({tenth(OVER_PCT)}, '% over budget') AS detail, 1::BIGINT AS weight
FROM budgets WHERE budget > 0 AND {OVER_PCT} BETWEEN 5 AND 15
UNION ALL SELECT 'invoice_moderately_overdue', coalesce(vendor, '?'), concat({DAYS}::VARCHAR, ' days overdue'), 1
FROM invoices WHERE status = 'UNPAID' AND {DAYS} BETWEEN 15 AND 30
UNION ALL SELECT 'contract_expiring_medium', vendor, concat({LEFT}::VARCHAR, ' days until expiry'), 1
FROM contracts WHERE {LEFT} BETWEEN 61 AND 90
UNION ALL SELECT 'new_episodic_pattern', 'System', concat(count(*)::VARCHAR, ' learned patterns active'), 2
FROM patterns HAVING count(*) > 0)
"""

CLUSTER = SIGNALS + """
, mark AS (SELECT sum(weight) AS score, count(*) AS n,
                  concat(sum(('0x' || substr(md5(concat(type, ':', subject)), 1, 15))::HUGEINT)::VARCHAR, ':',
                         count(*)::VARCHAR) AS f FROM signals),
clusters AS (SELECT concat('ws_', md5(f)) AS id, score::BIGINT AS score, n::BIGINT AS signals,
                    DATE '2001-08-15' AS detected_at, false AS acknowledged FROM mark WHERE score >= 4)
"""

BY_SUBJECT = SIGNALS + """
, per_type AS (SELECT subject, type, count(*) AS n, sum(weight) AS w FROM signals GROUP BY subject, type),
by_subject AS (
SELECT concat('ws_', md5(concat('["', string_agg(concat(type, ':', subject), '", "' ORDER BY type), '"]')))
         AS id, subject, sum(w)::BIGINT AS score, sum(n)::BIGINT AS signals
FROM per_type GROUP BY subject HAVING sum(w) >= 4)
"""


def _score(sev: str, impact: str, urgency: str) -> str:
    weight = f"CASE {sev} WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
    return f"round(({weight}) * greatest(0.1::DOUBLE, {impact}) * ({urgency}) * 10, 1)"


def _share(x: str, full: int) -> str:
    return f"least(1.0::DOUBLE, ({x})::DOUBLE / {full})"


def _advice(source: str) -> str:
    return "'" + decisions.ADVICE[source] + "'"


DECISIONS = CLUSTER + f"""
, db AS (SELECT *, actual - budget AS gap, {OVER_PCT} AS pct,
                CASE WHEN {OVER_PCT} > 20 THEN 'critical' WHEN {OVER_PCT} > 5 THEN 'warning' END AS sev
         FROM budgets WHERE budget > 0),
di AS (SELECT *, least({DAYS}, 365) AS days, CASE WHEN {DAYS} >= 60 THEN 'critical' ELSE 'warning' END AS sev
       FROM invoices WHERE status = 'UNPAID' AND {DAYS} >= 30),
dc AS (SELECT *, {LEFT} AS days,
              CASE WHEN {LEFT} <= 30 THEN 'critical' WHEN {LEFT} <= 60 THEN 'warning' ELSE 'info' END AS sev
       FROM contracts WHERE {LEFT} BETWEEN 0 AND 90),
dp AS (SELECT *, CASE WHEN confidence >= 0.75 THEN 'warning' ELSE 'info' END AS sev FROM patterns WHERE confidence >= 0.6),
dw AS (SELECT *, CASE WHEN score >= 7 THEN 'critical' ELSE 'warning' END AS sev FROM clusters WHERE score >= 4),
decisions AS (
SELECT concat_ws('_', 'budget_overrun', department, year::VARCHAR, category) AS id, 'Budget' AS source, sev AS severity,
       concat('Budget overrun: ', department) AS title,
       concat('Department ''', department, ''' actual spend (', {whole('actual')}, ' EUR) exceeds budget (',
              {whole('budget')}, ' EUR) by ', {tenth('pct')}, '%.') AS description,
       {_advice('Budget')} AS recommended_action, round(gap::DOUBLE, 2) AS financial_impact_eur,
       {_score('sev', _share('gap', 500000), '1.0::DOUBLE')} AS priority_score FROM db WHERE sev IS NOT NULL
UNION ALL
SELECT concat('overdue_invoice_', invoice_id), 'Invoice', sev, concat('Overdue invoice: ', coalesce(vendor, '?')),
       concat('Invoice from ''', coalesce(vendor, '?'), ''' for ', {whole('amount')}, ' EUR is ', days::VARCHAR,
              ' days overdue.'), {_advice('Invoice')}, round(amount::DOUBLE, 2),
       {_score('sev', _share('amount', 100000), '1 + least(days::DOUBLE / 100, 1.0::DOUBLE)')} FROM di
UNION ALL
SELECT concat('expiring_contract_', contract_id), 'Contract', sev, concat('Contract expiring: ', vendor),
       concat('Contract with ''', vendor, ''' (value: ', {whole('annual_value')}, ' EUR/yr) expires in ',
              days::VARCHAR, ' days.'), {_advice('Contract')}, round(annual_value::DOUBLE, 2),
       {_score('sev', _share('annual_value', 500000), '1 + (90 - days)::DOUBLE / 100')} FROM dc
UNION ALL
SELECT concat('episodic_', id), 'Episodic Memory', sev, concat('Recurring pattern: ', type, ' — ', subject),
       description, {_advice('Episodic Memory')}, 0.0::DOUBLE, {_score('sev', 'confidence', '1.0::DOUBLE')} FROM dp
UNION ALL
SELECT concat('weak_signal_', id), 'Weak Signal', sev,
       concat('Financial stress cluster detected (score: ', score::VARCHAR, ')'),
       'Multiple correlated weak signals indicate hidden financial stress. Individual signals are below alert threshold but combined score is high.',
       {_advice('Weak Signal')}, 0.0::DOUBLE, {_score('sev', _share('score', 10), '1.2::DOUBLE')} FROM dw),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority_score DESC, id) AS rn FROM decisions),
ranked AS (SELECT * EXCLUDE (rn) FROM best WHERE rn <= 5 ORDER BY priority_score DESC, id LIMIT 20)
"""


def _rscore(impact: str, urgency: str, conf: str) -> str:
    d = "::DOUBLE"
    return (f"round(least(100.0{d}, (({impact} * 0.4{d}) + ({urgency} * 0.4{d}) + ({conf} * 0.2{d})) * 100), 1)")


RECOMMENDATIONS = DECISIONS + f"""
, rc AS (SELECT *, actual - budget AS gap, {OVER_PCT} AS pct FROM budgets WHERE budget > 0 AND {OVER_PCT} > 10),
rs AS (SELECT *, budget - actual AS spare, (budget - actual)::DOUBLE / budget::DOUBLE * 100 AS pct FROM budgets
       WHERE budget > 0 AND (budget - actual)::DOUBLE / budget::DOUBLE * 100 >= 15),
ri AS (SELECT *, least({DAYS}, 365) AS days FROM invoices WHERE status = 'UNPAID' AND {DAYS} >= 30),
rk AS (SELECT *, {LEFT} AS days FROM contracts WHERE {LEFT} BETWEEN 1 AND 90),
rw AS (SELECT count(*) AS n, max(score) AS score FROM clusters HAVING count(*) > 0),
recs AS (
SELECT concat_ws('_', 'rec_cost', department, year::VARCHAR, category) AS id, 'cost_reduction' AS category,
       concat('Reduce spend in ', department, ' department') AS title,
       concat('Department is ', {tenth('pct')}, '% over budget (', {whole('gap')},
              ' EUR). Implement spend controls and freeze discretionary purchases.') AS description,
       {_rscore(_share('gap', 500000), _share('pct', 50), '0.85::DOUBLE')} AS priority_score,
       round(gap::DOUBLE * 0.5, 0) AS expected_impact_eur, 0.85::DOUBLE AS confidence,
       concat('Budget: ', {whole('budget')}, ' EUR|Actual: ', {whole('actual')}, ' EUR|Overrun: ', {tenth('pct')}, '%')
         AS supporting_evidence FROM rc
UNION ALL
SELECT concat('rec_overbilling_', replace(subject, ' ', '_')), 'cost_reduction',
       concat('Renegotiate contract with ', subject), description,
       {_rscore('0.5::DOUBLE', '0.6::DOUBLE', 'confidence')}, 0.0::DOUBLE, confidence, description
FROM patterns WHERE type = 'vendor_overbilling' AND confidence >= 0.6
UNION ALL
SELECT concat('rec_contract_', contract_id), 'risk_mitigation', concat('Renew contract: ', vendor),
       concat('Contract with ''', vendor, ''' (value: ', {whole('annual_value')}, ' EUR/yr) expires in ', days::VARCHAR,
              ' days. Failure to renew risks service disruption.'),
       {_rscore(_share('annual_value', 500000), _share('90 - days', 90), '0.95::DOUBLE')},
       round(annual_value::DOUBLE, 0), 0.95::DOUBLE,
       concat('Days until expiry: ', days::VARCHAR, '|Annual value: ', {whole('annual_value')}, ' EUR') FROM rk
UNION ALL
SELECT concat('rec_invoice_', invoice_id), 'risk_mitigation', concat('Resolve overdue invoice: ', coalesce(vendor, '?')),
       concat('Invoice of ', {whole('amount')}, ' EUR from ''', coalesce(vendor, '?'), ''' is ', days::VARCHAR,
              ' days overdue. Escalate to prevent vendor relationship damage.'),
       {_rscore(_share('amount', 100000), _share('days', 120), '0.9::DOUBLE')},
       round(amount::DOUBLE, 0), 0.9::DOUBLE,
       concat('Days overdue: ', days::VARCHAR, '|Amount: ', {whole('amount')}, ' EUR') FROM ri
UNION ALL
SELECT 'rec_weaksignal_cluster', 'risk_mitigation', 'Financial stress cluster requires holistic review',
       concat(n::VARCHAR, ' correlated weak signal cluster(s) detected. Combined score indicates elevated financial risk.'),
       {_rscore(_share('score', 10), '0.7::DOUBLE', '0.75::DOUBLE')}, 0.0::DOUBLE, 0.75::DOUBLE,
       concat('Active clusters: ', n::VARCHAR, '|Max stress score: ', score::VARCHAR) FROM rw
UNION ALL
SELECT concat_ws('_', 'rec_reallocate', department, year::VARCHAR, category), 'revenue_optimization',
       concat('Reallocate surplus from ', department),
       concat('Department ''', department, ''' is ', {tenth('pct')}, '% under budget (', {whole('spare')},
              ' EUR available). Reallocate to high-growth areas.'),
       {_rscore(_share('spare', 300000), '0.4::DOUBLE', '0.8::DOUBLE')}, round(spare::DOUBLE * 0.8, 0), 0.8::DOUBLE,
       concat('Surplus: ', {whole('spare')}, ' EUR|Under-budget: ', {tenth('pct')}, '%') FROM rs)
"""

RESOLVED = """
, resolved AS (SELECT id, entity_type, entity_id, metric, predicted_value::DOUBLE AS predicted_value,
       actual_value::DOUBLE AS actual_value,
       round(abs(actual_value::DOUBLE - predicted_value::DOUBLE) / abs(predicted_value::DOUBLE) * 100, 2) AS error_pct,
       coalesce(abs(actual_value::DOUBLE - predicted_value::DOUBLE) / abs(predicted_value::DOUBLE) * 100 > 20, false)
         AS reindexed FROM predictions)
"""

# ------------------------------------------------------------------- relations


@query("contracts_by_clause", """
SELECT c.contract_id, vendor, cl.description AS clause_description
FROM contracts c JOIN clauses cl USING (contract_id) WHERE cl.type = 'penalty'""")
def _(t):
    return links.contracts_by_clause(t.contracts(), t.clauses(), "penalty")


@query("payment_patterns", """
, signed AS (SELECT DISTINCT i.client, e.contract_id FROM invoices i JOIN edges_generates e USING (invoice_id)
             WHERE client IS NOT NULL),
d AS (SELECT s.client, i.paid_date - i.due_date AS d FROM signed s JOIN edges_generates e USING (contract_id)
      JOIN invoices i ON i.invoice_id = e.invoice_id WHERE i.status = 'PAID')
SELECT client, round(avg(d), 4) AS avg_delay_days, round(stddev_samp(d), 4) AS delay_stddev,
       min(d)::BIGINT AS min_delay, max(d)::BIGINT AS max_delay, count(*)::BIGINT AS total_invoices
FROM d GROUP BY client""")
def _(t):
    inv = t.kept("invoices", t.invoices)
    rows = links.payment_patterns(t.client_contracts(inv), t.edges_generates(inv), inv)
    return edge(rows, avg_delay_days=4, delay_stddev=4)


@query("contract_with_invoices", """
, p AS (SELECT contract_id, ceil(count(*) / 50.0)::BIGINT AS pages FROM edges_generates GROUP BY contract_id),
x AS (SELECT c.contract_id, c.vendor, annual_value, i.invoice_id, amount, status,
             CASE WHEN i.invoice_id IS NOT NULL THEN coalesce(DATE '2001-08-15' - due_date, 0) END::BIGINT AS days,
             ('0x' || substr(md5(i.invoice_id), 1, 8))::BIGINT AS h
      FROM contracts c LEFT JOIN (edges_generates e JOIN invoices i ON e.invoice_id = i.invoice_id) ON c.contract_id = e.contract_id),
y AS (SELECT x.*, CASE WHEN pages > 1 AND invoice_id IS NOT NULL THEN h % pages ELSE 0 END AS page,
             concat_ws(':', invoice_id, coalesce(amount::VARCHAR, ''), status, days::VARCHAR) AS detail
      FROM x LEFT JOIN p ON x.contract_id = p.contract_id)
SELECT contract_id, vendor, annual_value::DOUBLE AS annual_value, page::BIGINT AS page,
       count(invoice_id)::BIGINT AS invoices, coalesce(sum(amount), 0)::DOUBLE AS amount,
       coalesce(string_agg(invoice_id, ',' ORDER BY invoice_id), '') AS ids,
       coalesce(string_agg(detail, ',' ORDER BY invoice_id, amount NULLS FIRST, status, days) FILTER (invoice_id IS NOT NULL), '') AS details
FROM y GROUP BY contract_id, vendor, annual_value, page""")
def _(t):
    """Every contract with every invoice under it, in pages of about 50: their number, sum, ids, and each one's amount, status and days overdue."""
    inv = kept_billed(t)
    edges = t.kept("edges", lambda: t.edges_generates(inv))
    pages = links.invoices_in_pages(links.contract_with_invoices(t.contracts(), edges, inv, AS_OF), edges, page_size=50)

    def detail(x):
        return F.concat_ws(":", x.invoice_id, F.coalesce(x.amount.cast("string"), F.lit("")), x.status, x.days_overdue.cast("string"))

    return edge(pages.select(
        "contract_id", "vendor", "annual_value", "page", "invoices", "amount",
        F.array_join(F.transform("items", lambda x: x.invoice_id), ",").alias("ids"),
        F.array_join(F.transform("items", detail), ",").alias("details")))


@query("vendor_summary", PATTERNS + """
, c AS (SELECT vendor, count(DISTINCT contract_id) AS n, sum(annual_value) AS v, sum(DISTINCT annual_value) AS d
        FROM contracts GROUP BY vendor),
i AS (SELECT vendor, count(DISTINCT invoice_id) AS n, sum(amount) AS v, sum(DISTINCT amount) AS d
      FROM invoices WHERE vendor IS NOT NULL GROUP BY vendor),
p AS (SELECT subject, string_agg(DISTINCT description, '|' ORDER BY description) AS d FROM patterns GROUP BY subject)
SELECT coalesce(c.vendor, i.vendor) AS vendor, coalesce(c.n, 0)::BIGINT AS contract_count,
       coalesce(i.n, 0)::BIGINT AS invoice_count, coalesce(c.v, 0)::DOUBLE AS total_contract_value,
       coalesce(c.d, 0)::DOUBLE AS total_contract_value_distinct, coalesce(i.v, 0)::DOUBLE AS total_invoiced,
       coalesce(i.d, 0)::DOUBLE AS total_invoiced_distinct, coalesce(p.d, '') AS patterns
FROM c FULL JOIN i ON c.vendor = i.vendor LEFT JOIN p ON p.subject = coalesce(c.vendor, i.vendor)""")
def _(t):
    out = links.vendor_summary(t.contracts(), kept_billed(t), found_patterns(t))
    return edge(out.withColumn("patterns", F.array_join("patterns", "|")))


@query("link_by_vendor", """
SELECT contract_id, invoice_id FROM edges_generates e JOIN invoices i USING (invoice_id) WHERE i.status <> 'PAID'""")
def _(t):
    """Edges of paid invoices are in place already; the rest are missing."""
    inv = kept_billed(t)
    existing = links.match_by_vendor(t.contracts(), inv.where("status = 'PAID'"))
    return links.link_by_vendor(t.contracts(), inv, existing)


@query("link_by_id", """
SELECT DISTINCT concat('CTR-', l_suppkey::VARCHAR) AS contract_id, concat('INV-', l_orderkey::VARCHAR) AS invoice_id
FROM lineitem
WHERE concat('CTR-', l_suppkey::VARCHAR) IN (SELECT contract_id FROM contracts)
  AND concat('INV-', l_orderkey::VARCHAR) IN (SELECT invoice_id FROM invoices)
  AND (concat('CTR-', l_suppkey::VARCHAR), concat('INV-', l_orderkey::VARCHAR)) NOT IN
      (SELECT (contract_id, invoice_id) FROM edges_generates)""")
def _(t):
    """Every supplier of an order line asks for an edge; those of the first line exist."""
    wanted = t.read("lineitem").select(
        F.concat(F.lit("CTR-"), F.col("l_suppkey").cast("string")).alias("contract_id"),
        F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string")).alias("invoice_id"))
    inv = kept_billed(t)
    return links.link_by_id(wanted, t.contracts(), inv, t.edges_generates(inv))


@query("vendor_picture", PATTERNS + """
, n AS (SELECT contract_id, count(*) AS n FROM edges_generates GROUP BY contract_id),
p AS (SELECT subject, string_agg(DISTINCT type, ',' ORDER BY type) AS d FROM patterns GROUP BY subject)
SELECT vendor, c.contract_id, coalesce(n, 0)::BIGINT AS invoices, coalesce(d, '') AS pattern_types
FROM contracts c LEFT JOIN n ON c.contract_id = n.contract_id LEFT JOIN p ON subject = vendor""")
def _(t):
    out = links.vendor_picture(t.contracts(), t.edges_generates(kept_billed(t)), found_patterns(t))
    return edge(out.withColumn("pattern_types", F.array_join("pattern_types", ",")))


# -------------------------------------------------------------------- patterns


@query("pattern_vendor_overbilling", PATTERNS + f"SELECT {PATTERN_COLUMNS} FROM p1")
def _(t):
    return patterns.vendor_overbilling(billed(t), t.contracts())


@query("pattern_dept_overspend", PATTERNS + f"SELECT {PATTERN_COLUMNS} FROM p2")
def _(t):
    return patterns.dept_overspend(t.budgets())


@query("pattern_late_payment", PATTERNS + f"SELECT {PATTERN_COLUMNS} FROM p3")
def _(t):
    return patterns.late_payment(billed(t), AS_OF)


@query("pattern_seasonal_spike", PATTERNS + f"SELECT {PATTERN_COLUMNS} FROM p4")
def _(t):
    return patterns.spend_spike(t.budgets())


@query("patterns_all", PATTERNS + f"SELECT {PATTERN_COLUMNS}, acknowledged, last_updated FROM patterns")
def _(t):
    return found_patterns(t)


@query("patterns_by_type", PATTERNS + f"SELECT {PATTERN_COLUMNS} FROM patterns WHERE type = 'late_payment_pattern'")
def _(t):
    return patterns.patterns_by_type(found_patterns(t).drop("acknowledged", "last_updated"), "late_payment_pattern")


@query("pattern_lines", PATTERNS + """
SELECT id, concat('[', upper(type), ' | confidence=', round(confidence * 100, 0)::BIGINT::VARCHAR, '%] ', description) AS line
FROM (SELECT * FROM patterns ORDER BY confidence DESC, id LIMIT 8)""")
def _(t):
    return patterns.pattern_lines(found_patterns(t))


# --------------------------------------------------------------------- signals


@query("weak_signal_list", SIGNALS + "SELECT type, subject, detail, weight FROM signals")
def _(t):
    return found_signals(t)


@query("weak_signal_cluster", CLUSTER + "SELECT * FROM clusters")
def _(t):
    return found_cluster(t)


@query("weak_signal_by_subject", BY_SUBJECT + "SELECT * FROM by_subject")
def _(t):
    return signals.cluster_by_subject(found_signals(t), AS_OF).select("id", "subject", "score", "signals")


@query("weak_signal_new", BY_SUBJECT + "SELECT * FROM by_subject WHERE ascii(md5(subject)) % 3 <> 0")
def _(t):
    """The clusters by subject that a stored third of them does not hold yet."""
    found = signals.cluster_by_subject(found_signals(t), AS_OF).select("id", "subject", "score", "signals")
    stored = found.where("ascii(md5(subject)) % 3 = 0")
    return signals.unknown(found, stored)


@query("active_signals", BY_SUBJECT + """
SELECT b.id, b.score, p.type, p.subject, p.n::BIGINT AS signals, p.w::BIGINT AS weight
FROM by_subject b JOIN per_type p USING (subject)""")
def _(t):
    """The stored clusters with their JSON opened again, one row per entry."""
    act = signals.active_signals(signals.cluster_by_subject(found_signals(t), AS_OF))
    return act.select("id", "score", F.inline("signals"))


# ----------------------------------------------------------- ranked decisions


@query("ranked_decisions", DECISIONS + "SELECT * FROM ranked")
def _(t):
    return ranked(t)


@query("alert_view", DECISIONS + f"""
SELECT id, CASE WHEN severity IN ('critical', 'warning') THEN severity ELSE 'info' END AS type, source AS category,
       title, description, recommended_action AS recommendation,
       CASE WHEN financial_impact_eur > 0 THEN concat('Financial impact: ', {whole('financial_impact_eur')}, ' EUR')
            ELSE concat('Priority score: ', {whole('priority_score')}) END AS impact FROM ranked""")
def _(t):
    return decisions.alert_view(ranked(t))


@query("alert_counts", DECISIONS + "SELECT severity, count(*)::BIGINT AS n FROM ranked GROUP BY severity")
def _(t):
    return metrics.alert_counts(ranked(t))


# ------------------------------------------------------------- recommendations


@query("recommendations", RECOMMENDATIONS + "SELECT *, DATE '2001-08-15' AS created_at, false AS acknowledged FROM recs")
def _(t):
    return recommended(t).withColumn("supporting_evidence", F.array_join("supporting_evidence", "|"))


@query("top_recommendations", RECOMMENDATIONS + """
SELECT id, category, title, priority_score, expected_impact_eur, confidence FROM recs
ORDER BY priority_score DESC, id LIMIT 20""")
def _(t):
    return recommendations.top_recommendations(recommended(t)).select(
        "id", "category", "title", "priority_score", "expected_impact_eur", "confidence")


@query("ack_recommendation", RECOMMENDATIONS + """
SELECT id, category, category = 'cost_reduction' AS acknowledged FROM recs""")
def _(t):
    """All cost recommendations acknowledged, then generated anew: the flag stays."""
    fresh = t.kept("recommendations", lambda: recommended(t))
    stored = lookups.acknowledge(fresh, fresh.where("category = 'cost_reduction'"))
    return recommendations.keep_acknowledged(fresh, stored).select("id", "category", "acknowledged")


@query("score_histogram", RECOMMENDATIONS + """
SELECT category, CASE WHEN priority_score <= 25 THEN '0-25' WHEN priority_score <= 50 THEN '26-50'
                      WHEN priority_score <= 75 THEN '51-75' ELSE '76-100' END AS band,
       count(*)::BIGINT AS n, count(*) FILTER (priority_score > 70)::BIGINT AS high_priority FROM recs GROUP BY 1, 2""")
def _(t):
    return metrics.score_histogram(recommended(t))


@query("context_lines", RECOMMENDATIONS + f"""
SELECT 'decision' AS part, id, concat('[', upper(severity), '] ', title, ' (score: ', {tenth('priority_score')}, ', impact: ',
       {whole('financial_impact_eur')}, ' EUR) — ', recommended_action) AS line
FROM (SELECT * FROM ranked ORDER BY priority_score DESC, id LIMIT 5)
UNION ALL
SELECT 'recommendation', id, concat('[', category, '] ', title, ' (priority: ', {whole('priority_score')}, '/100, impact: ',
       {whole('expected_impact_eur')}, ' EUR)')
FROM (SELECT * FROM recs ORDER BY priority_score DESC, id LIMIT 5)""")
def _(t):
    """Decisions and recommendations as the lines a reader would be given."""
    d = decisions.decision_lines(ranked(t, 5)).withColumn("part", F.lit("decision"))
    r = recommendations.recommendation_lines(
        recommendations.top_recommendations(recommended(t), 5)).withColumn("part", F.lit("recommendation"))
    return d.unionByName(r).orderBy("part", F.desc("priority_score"), "id").select("part", "id", "line")


# -------------------------------------------------------------------- feedback


@query("feedback_resolve", RESOLVED + "SELECT * FROM resolved")
def _(t):
    return edge(resolved(t))


@query("accuracy_stats", RESOLVED + """
SELECT entity_type, count(*)::BIGINT AS n,
       round(sum(error_pct::DECIMAL(18,2))::DOUBLE / count(*), 2) AS avg_error_pct,
       min(error_pct) AS best_error_pct, max(error_pct) AS worst_error_pct
FROM resolved WHERE error_pct IS NOT NULL GROUP BY entity_type""")
def _(t):
    return feedback.accuracy_stats(resolved(t))


@query("reindex_queue", RESOLVED + """
, k AS (SELECT entity_id, arg_min(entity_type, id) AS entity_type FROM resolved GROUP BY entity_id)
SELECT concat('reindex_', entity_id) AS doc_id, entity_id, entity_type,
       concat(entity_type, ' entity ', entity_id, ' reindexed after prediction error exceeding 20.0%') AS text
FROM k WHERE entity_id IN (SELECT entity_id FROM resolved WHERE reindexed)""")
def _(t):
    return feedback.reindex_queue(resolved(t))


@query("predictions_append", """
SELECT id, entity_type, entity_id, metric, predicted_value::DOUBLE AS predicted_value,
       actual_value::DOUBLE AS actual_value FROM predictions
UNION ALL
SELECT md5(concat_ws('|', 'invoice', client, 'payment_total', sum(amount)::DECIMAL(18,2)::VARCHAR, '2001-08-15')),
       'invoice', client, 'payment_total', sum(amount)::DOUBLE, NULL FROM invoices WHERE status = 'UNPAID' GROUP BY client""")
def _(t):
    """Open predictions for what each client will pay, added to the stored ones."""
    new = (t.invoices(vendor=False, paid=False).where("status = 'UNPAID'").groupBy(F.col("client").alias("entity_id"))
           .agg(F.sum("amount").cast("decimal(18,2)").alias("predicted_value"))
           .select(F.lit("invoice").alias("entity_type"), "entity_id", F.lit("payment_total").alias("metric"),
                   "predicted_value"))
    return edge(feedback.append_predictions(t.predictions(), new, AS_OF))
