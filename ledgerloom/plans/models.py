"""Projections, distributions, duplicates and vector search."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerloom.operators import distribution, duplicates, links, metrics, numbering, projections, vectors
from ledgerloom.plans.catalog import query
from ledgerloom.plans.cleaning import exact
from ledgerloom.plans.edge import edge
from ledgerloom.plans.entities import AS_OF, Tables, money

STARTING = 100000.0
MONTHS = 6
CHANGES = [-20, -10, 0, 10, 20]
SETTINGS = [(10, 3, 5), (0, 6, 2), (25, 0, 10)]


def client_flows(t: Tables):
    """Monthly inflows and outflows per client."""
    amount = money("o_totalprice")
    return t.read("orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month_start")).agg(
        F.sum(amount).alias("inflows"), F.sum(F.when(F.col("o_orderkey") % 10 < 9, amount)).alias("outflows"))


def client_baseline(t: Tables):
    return projections.flow_baseline(client_flows(t), ["o_custkey"])


CLIENT_BASE = """
WITH flows AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice::DECIMAL(18,2)) AS i,
                      sum(CASE WHEN o_orderkey % 10 < 9 THEN o_totalprice::DECIMAL(18,2) END) AS o
               FROM orders GROUP BY 1, 2),
base AS (SELECT o_custkey, sum(i)::DOUBLE / count(*) AS avg_in, sum(coalesce(o, 0))::DOUBLE / count(*) AS avg_out
         FROM flows GROUP BY o_custkey),
months(m, f) AS (VALUES """ + ", ".join(
    f"({m}, {1 + 0.2 * math.sin(2 * math.pi * ((AS_OF.month + m - 1) % 12 + 1) / 12)!r}::DOUBLE)"
    for m in range(1, MONTHS + 1)) + """),
"""


def _paths(rows: list[tuple]) -> str:
    values = ", ".join(f"('{n}', {i}::DOUBLE, {o}::DOUBLE)" for n, i, o in rows)
    return CLIENT_BASE + f"""
sc(scenario, im, om) AS (VALUES {values}),
nets AS (SELECT o_custkey, scenario, m, avg_in * im * f AS i, avg_out * om AS o FROM base, sc, months),
raw AS (SELECT *, 100000 + sum(i - o) OVER (PARTITION BY o_custkey, scenario ORDER BY m) AS closing FROM nets),
path AS (SELECT o_custkey, scenario, m::BIGINT AS month, round(closing - (i - o), 2) AS starting_balance,
                {exact('i')} AS inflows, {exact('o')} AS outflows, {exact('i - o')} AS net_cashflow,
                round(closing, 2) AS ending_balance FROM raw)
"""


@query("cashflow_scenarios", _paths(projections.SCENARIOS) + """
SELECT o_custkey, scenario, month, round(starting_balance, 0) AS starting_balance, round(inflows, 0) AS inflows,
       round(outflows, 0) AS outflows, round(net_cashflow, 0) AS net_cashflow, round(ending_balance, 0) AS ending_balance
FROM path""", finance=False)
def _(t):
    """Six months ahead for every client under three scenarios."""
    rows = projections.project_cashflow(client_baseline(t), ["o_custkey"], MONTHS, AS_OF.month, STARTING)
    return edge(rows, **{c: 0 for c in ("starting_balance", "inflows", "outflows", "net_cashflow", "ending_balance")})


@query("cashflow_summary", _paths(projections.SCENARIOS) + """
SELECT o_custkey, scenario, round(arg_max(ending_balance, month), 0) AS final_balance,
       round(min(ending_balance), 0) AS min_balance, round(max(ending_balance), 0) AS max_balance,
       round(sum(inflows::DECIMAL(28,2))::DOUBLE, 0) AS total_inflows, round(sum(outflows::DECIMAL(28,2))::DOUBLE, 0) AS total_outflows,
       round(sum(net_cashflow::DECIMAL(28,2))::DOUBLE, 0) AS total_net_cashflow, min(ending_balance) < 0 AS liquidity_crisis
FROM path GROUP BY o_custkey, scenario""", finance=False)
def _(t):
    path = projections.project_cashflow(client_baseline(t), ["o_custkey"], MONTHS, AS_OF.month, STARTING)
    rows = projections.summarise_cashflow(path, ["o_custkey"])
    return edge(rows, **{c: 0 for c in ("final_balance", "min_balance", "max_balance", "total_inflows",
                                        "total_outflows", "total_net_cashflow")})


@query("cashflow_stress", _paths(projections.SHOCKS) + """
SELECT o_custkey, scenario AS shock, min(ending_balance) >= 0 AS survives, round(min(ending_balance), 0) AS min_balance,
       round(arg_max(ending_balance, month), 0) AS final_balance,
       min(CASE WHEN ending_balance < 0 THEN month END) AS months_until_crisis
FROM path GROUP BY o_custkey, scenario""", finance=False)
def _(t):
    rows = projections.stress_cashflow(client_baseline(t), ["o_custkey"], AS_OF.month, STARTING, MONTHS)
    return edge(rows, min_balance=0, final_balance=0)


@query("liquidity", """
, b AS (SELECT sum(inflows)::DOUBLE / count(*) AS i, sum(coalesce(outflows, 0))::DOUBLE / count(*) AS o FROM monthly_flows),
d AS (SELECT avg(x) AS d FROM (SELECT avg(paid_date - due_date) AS x FROM invoices
      WHERE status = 'PAID' AND client IS NOT NULL GROUP BY client)),
f AS (SELECT round(i / 30 * greatest(0, 90 - d), 2) AS r, round(o / 30 * 90, 2) AS p FROM b, d)
SELECT r AS expected_receivables, p AS expected_payables, round(100000 + r - p, 2) AS expected_balance,
       round(round(100000 + r - p, 2) / p, 4) AS liquidity_ratio,
       CASE WHEN 100000 + r - p < 0 THEN 'CRITICAL' WHEN 100000 + r - p < p * 0.2 THEN 'HIGH'
            WHEN 100000 + r - p < p * 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 90::BIGINT AS days_ahead FROM f""")
def _(t):
    base = projections.flow_baseline(t.monthly_flows(), [])
    days = F.datediff("paid_date", "due_date")
    delays = (t.invoices(vendor=False).where("status = 'PAID' AND client IS NOT NULL").groupBy("client")
              .agg(F.avg(days).alias("avg_delay_days")))
    return edge(projections.liquidity(base, delays, 90, True, STARTING))


DEPARTMENTS = {"AUTOMOBILE": "Marketing", "BUILDING": "Sales", "FURNITURE": "IT", "HOUSEHOLD": "R&D", "MACHINERY": "HR"}


def department_baseline(t: Tables):
    names = F.create_map(*[F.lit(x) for pair in DEPARTMENTS.items() for x in pair])
    return metrics.dept_baseline(t.budgets()).withColumn("department", F.try_element_at(names, F.col("department")))


CHANGE_SQL = """
, b0 AS (SELECT CASE department WHEN 'AUTOMOBILE' THEN 'Marketing' WHEN 'BUILDING' THEN 'Sales' WHEN 'FURNITURE' THEN 'IT'
                     WHEN 'HOUSEHOLD' THEN 'R&D' WHEN 'MACHINERY' THEN 'HR' END AS department,
                avg(budget::DOUBLE) AS monthly_budget,
                stddev_samp((actual - budget)::DOUBLE) / avg(budget::DOUBLE) AS variance FROM budgets GROUP BY 1),
ch(change_percent) AS (VALUES (-20.0::DOUBLE), (-10.0::DOUBLE), (0.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)),
g AS (SELECT *, monthly_budget * (1 + change_percent / 100) AS nb,
        CASE department WHEN 'Marketing' THEN 3.0 WHEN 'Sales' THEN 5.0 WHEN 'IT' THEN 0.5 WHEN 'R&D' THEN 10.0
             WHEN 'HR' THEN 0.3 ELSE 1.0 END::DOUBLE AS mult,
        CASE WHEN department = 'Sales' THEN least(1.0, 0.7 + m / 12.0::DOUBLE * 0.3)
             WHEN department IN ('Marketing', 'R&D') THEN 1 / (1 + exp(-10 * (m / 12.0::DOUBLE - 0.5)))
             ELSE m / 12.0::DOUBLE END AS f FROM b0, ch, range(1, 13) r(m)),
w AS (SELECT department, change_percent, m::BIGINT AS month, variance, (nb - monthly_budget) * mult * f AS revenue, nb AS cost,
             sum((nb - monthly_budget) * mult * f) OVER (PARTITION BY department, change_percent ORDER BY m) AS cr, nb * m AS cc FROM g),
proj AS (SELECT department, change_percent, month, round(revenue, 2) AS revenue, round(cost, 2) AS cost,
                round(cr, 2) AS cumulative_revenue, round(cc, 2) AS cumulative_costs, round((cr - cc) / cc, 4) AS roi,
                round((cr - cc) / cc - 1.96 * variance, 4) AS roi_low, round((cr - cc) / cc + 1.96 * variance, 4) AS roi_high FROM w)
"""


@query("budget_change_projection", CHANGE_SQL + "SELECT * FROM proj")
def _(t):
    return edge(projections.project_budget_change(department_baseline(t), CHANGES, 12))


@query("scenario_compare", CHANGE_SQL + """
, l AS (SELECT * FROM proj WHERE month = 12),
x AS (SELECT department, arg_max(change_percent, roi) AS bc, max(roi) AS br, arg_min(change_percent, roi) AS wc, min(roi) AS wr
      FROM l GROUP BY department)
SELECT department, bc AS best_change, br AS best_roi, wc AS worst_change, wr AS worst_roi,
       CASE WHEN bc > 0 THEN concat('Recommend increasing budget by ', abs(bc)::BIGINT::VARCHAR, '% for expected ROI of ',
                                    round(br * 100, 1)::DECIMAL(18,1)::VARCHAR, '%')
            WHEN bc < 0 THEN concat('Recommend decreasing budget by ', abs(bc)::BIGINT::VARCHAR, '% (ROI: ',
                                    round(br * 100, 1)::DECIMAL(18,1)::VARCHAR, '%)')
            ELSE concat('Recommend maintaining current budget (ROI: ', round(br * 100, 1)::DECIMAL(18,1)::VARCHAR, '%)') END
         AS recommendation FROM x""")
def _(t):
    path = projections.project_budget_change(department_baseline(t), CHANGES, 12)
    return projections.compare_changes(path, CHANGES)


@query("breakeven", """
, r AS (SELECT c.contract_id, annual_value::DOUBLE AS need, coalesce(sum(i.amount)::DOUBLE / 80, 0) AS gain
        FROM contracts c LEFT JOIN invoices i ON i.vendor = c.vendor GROUP BY 1, 2)
SELECT contract_id, need AS initial_investment, round(gain, 2) AS monthly_return,
       (SELECT min(m) FROM range(1, 25) g(m) WHERE m * gain >= need)::BIGINT AS breakeven_month FROM r""")
def _(t):
    """Months until what a vendor bills makes up for its contract's yearly value."""
    billed = t.invoices(client=False, paid=False).groupBy("vendor").agg(
        (F.sum("amount").cast("double") / 80).alias("monthly_return"))
    rows = t.contracts().join(billed, "vendor", "left").select(
        "contract_id", F.col("annual_value").cast("double").alias("initial_investment"),
        F.coalesce("monthly_return", F.lit(0.0)).alias("monthly_return"))
    return edge(projections.breakeven(rows), monthly_return=2)


@query("whatif_grid", f"""
, b AS (SELECT department, sum(budget)::DOUBLE / (12 * count(DISTINCT year)) AS mb FROM budgets GROUP BY department),
p(cut, inflation, growth) AS (VALUES {', '.join(f'({a}, {b}, {c})' for a, b, c in SETTINGS)}),
m(month, s) AS (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x in enumerate(projections.SEASONAL, 1))})
SELECT department, cut::BIGINT AS budget_cut, inflation::BIGINT AS inflation, growth::BIGINT AS growth, month::BIGINT AS month,
       floor(mb * s / 1000 + 0.5)::BIGINT AS baseline, floor(mb * s * (1 - cut / 100.0::DOUBLE) / 1000 + 0.5)::BIGINT AS with_cuts,
       floor(mb * s * pow(1 + inflation / 100.0::DOUBLE, month / 12.0::DOUBLE) / 1000 + 0.5)::BIGINT AS with_inflation,
       floor(mb * s * (1 - cut / 100.0::DOUBLE) * pow(1 + growth / 100.0::DOUBLE, month / 12.0::DOUBLE) * 0.97 / 1000 + 0.5)::BIGINT AS optimized
FROM b, p, m""")
def _(t):
    base = t.budgets().groupBy("department").agg(
        (F.sum("budget").cast("double") / (12 * F.count_distinct("year"))).alias("monthly_budget"))
    return edge(projections.whatif_grid(base, SETTINGS))


# ---------------------------------------------------------------- distributions

SHARES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


@query("distribution_summary", "SELECT count(*)::BIGINT AS n, round(avg(x), 2) AS mean, round(stddev_pop(x), 2) AS std, "
       "min(x) AS min, max(x) AS max, round(avg((x > 0)::INT), 4) AS probability_positive, "
       + ", ".join(f"{exact(f'quantile_cont(x, {p})')} AS {distribution.name_of(p)}" for p in SHARES)
       + " FROM (SELECT c_acctbal::DOUBLE AS x FROM customer)", finance=False)
def _(t):
    rows = distribution.summary(t.read("customer"), "c_acctbal", SHARES)
    return edge(rows, mean=2, std=2, probability_positive=4, **{distribution.name_of(p): 2 for p in SHARES})


@query("var_cvar", """
WITH v AS (SELECT quantile_cont(l_extendedprice, 0.05) AS var FROM lineitem)
SELECT round(var, 2) AS var, round(avg(l_extendedprice), 2) AS cvar FROM lineitem, v WHERE l_extendedprice <= var GROUP BY var""",
       finance=False)
def _(t):
    return edge(distribution.tail_risk(t.read("lineitem"), "l_extendedprice", 0.95), var=2, cvar=2)


# ------------------------------------------------------------------- duplicates


def with_copies(t: Tables):
    """Invoices, and copies of every 97th with one letter and a thousandth changed."""
    inv = t.invoices(client=False, paid=False).select(
        (F.col("o_orderkey") * 2).alias("id"), "vendor", F.col("amount").cast("double").alias("amount"), "date", "o_orderkey")
    copies = inv.where("o_orderkey % 97 = 0").select(
        (F.col("id") + 1).alias("id"), F.regexp_replace("vendor", "^S", "Z").alias("vendor"),
        (F.col("amount") * 1.001).alias("amount"), "date", "o_orderkey")
    twins = inv.where("o_orderkey % 89 = 0").select((-F.col("id") - 1).alias("id"), "vendor", "amount", "date", "o_orderkey")
    return inv.unionByName(copies).unionByName(twins).drop("o_orderkey")


@query("fuzzy_duplicates")
def _(t):
    """Near and exact copies among all invoices; tested against all pairs on a fixture."""
    return edge(duplicates.fuzzy_duplicates(with_copies(t)), similarity=6)


def incomplete(t: Tables):
    """Invoices under names that are equal or far apart (digests), some without date, amount or both, and copies a thousandth dearer."""
    k = F.col("o_orderkey")
    gone = F.conv(F.substring(F.md5(k.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 40
    inv = t.invoices(client=False, paid=False).select(
        (k * 2).alias("id"), F.md5(F.coalesce("vendor", F.lit("Comptoir")).cast("binary")).alias("vendor"),
        F.when(~gone.isin(0, 2), F.col("amount").cast("double")).alias("amount"), F.when(~gone.isin(1, 2), F.col("date")).alias("date"), "o_orderkey")
    dearer = inv.where("o_orderkey % 31 = 0").withColumns({"id": F.col("id") + 1, "amount": F.col("amount") * F.lit(1.001)})
    return inv.unionByName(dearer).drop("o_orderkey")


# Names of different digests are under 0.85 alike, so only one vendor's documents can match; of equal documents the first stands for all.
@query("fuzzy_vendor_duplicates", """
, k AS (SELECT o_orderkey, ('0x' || left(md5(o_orderkey::VARCHAR), 4))::INT AS h, * EXCLUDE (o_orderkey) FROM invoices),
a AS (SELECT o_orderkey, o_orderkey * 2 AS id, md5(coalesce(vendor, 'Comptoir')) AS vendor,
        CASE WHEN h % 40 NOT IN (0, 2) THEN amount::DOUBLE END AS amount, CASE WHEN h % 40 NOT IN (1, 2) THEN date END AS date FROM k),
x AS (SELECT id, vendor, amount, date FROM a UNION ALL SELECT id + 1, vendor, amount * 1.001::DOUBLE, date FROM a WHERE o_orderkey % 31 = 0),
f AS (SELECT vendor, amount, date, min(id) AS id FROM x GROUP BY ALL),
c AS (SELECT f.id AS id_a, x.id AS id_b, 1.0::DOUBLE AS similarity FROM x JOIN f ON x.vendor = f.vendor
        AND x.amount IS NOT DISTINCT FROM f.amount AND x.date IS NOT DISTINCT FROM f.date WHERE x.id > f.id),
p AS (SELECT a.id AS id_a, b.id AS id_b,
        CASE WHEN a.amount = b.amount THEN 1.0 WHEN least(a.amount, b.amount) / greatest(a.amount, b.amount) > 0.99
             THEN least(a.amount, b.amount) / greatest(a.amount, b.amount)
             WHEN a.amount IS NOT NULL AND b.amount IS NOT NULL THEN 0.0 END::DOUBLE AS n, (a.date = b.date)::INT::DOUBLE AS d
      FROM f a JOIN f b ON a.vendor = b.vendor AND a.id < b.id)
SELECT id_a, id_b, similarity FROM c
UNION ALL SELECT id_a, id_b, round((1 + coalesce(n, 0) + coalesce(d, 0)) / (1 + (n IS NOT NULL)::INT + (d IS NOT NULL)::INT), 6) AS s FROM p
WHERE (1 + coalesce(n, 0) + coalesce(d, 0)) / (1 + (n IS NOT NULL)::INT + (d IS NOT NULL)::INT) >= 0.95""")
def _(t):
    """Duplicates among documents that lack their numbers, vendors equal or far apart."""
    return edge(duplicates.fuzzy_duplicates(incomplete(t)), similarity=6)


@query("exact_key_duplicates", """
, x AS (SELECT vendor, amount::DOUBLE AS amount, date FROM invoices
        UNION ALL SELECT vendor, amount::DOUBLE, date FROM invoices WHERE o_orderkey % 89 = 0
        UNION ALL SELECT regexp_replace(vendor, '^S', 'Z'), amount::DOUBLE * 1.001::DOUBLE, date FROM invoices WHERE o_orderkey % 97 = 0)
SELECT vendor, round(amount, 2) AS amount, date, count(*)::BIGINT AS copies FROM x GROUP BY vendor, x.amount, date HAVING count(*) > 1""")
def _(t):
    return edge(duplicates.exact_key_duplicates(with_copies(t), ["vendor", "amount", "date"]), amount=2)


@query("dedup_first", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
       finance=False)
def _(t):
    return numbering.first_per_key(t.read("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


# ---------------------------------------------------------------------- vectors

DIM = 64


@query("embedding_profile", """
SELECT vec_id, len(embedding)::BIGINT AS dimension,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings""", finance=False)
def _(t):
    return edge(vectors.profile(t.read("embeddings")))


@query("cosine_topk", f"""
WITH c AS (SELECT label, [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, DIM + 1))}] AS q FROM embeddings GROUP BY label),
s AS (SELECT c.label AS query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM c, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, vec_id, round(score, 4) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 10""", finance=False)
def _(t):
    """The ten vectors closest to the centre of each label, over all vectors."""
    emb = t.read("embeddings")
    centres = vectors.centroids(emb, "label", DIM).withColumnRenamed("label", "query_id")
    return edge(vectors.cosine_topk(emb, centres, 10), score=4)


@query("vectors_upsert", """
SELECT doc_id, len(embedding)::BIGINT AS dimension, round(embedding[1]::DOUBLE, 4) AS first, type FROM (
  SELECT concat('V', vec_id::VARCHAR) AS doc_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 'invoice' ELSE 'document' END AS type FROM embeddings
  UNION ALL SELECT concat('W', vec_id::VARCHAR), embedding, 'contract' FROM embeddings WHERE vec_id % 3 = 0)""", finance=False)
def _(t):
    """A third of the vectors stored again under a better type, and as many added."""
    emb = t.read("embeddings")
    row = ["doc_id", "embedding", "text", "type"]
    stored = emb.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding",
                        F.lit("document text").alias("text"), F.lit("document").alias("type"))
    third = emb.where("vec_id % 3 = 0")
    again = third.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding",
                         F.lit("invoice text").alias("text"), F.lit("invoice").alias("type"))
    added = third.select(F.concat(F.lit("W"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding",
                         F.lit("contract text").alias("text"), F.lit("contract").alias("type"))
    merged = vectors.add_vectors(stored.select(*row), again.unionByName(added))
    return edge(merged.select("doc_id", F.size("embedding").alias("dimension"),
                              F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"), "type"))
