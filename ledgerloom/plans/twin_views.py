"""The finance entities as SQL, used only as the prefix of the DuckDB twins."""

FINANCE_VIEWS = """
WITH first_line AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, max(CAST(l_shipdate AS DATE)) AS last_ship
  FROM lineitem GROUP BY l_orderkey),
invoices AS (
  SELECT concat('INV-', CAST(o_orderkey AS VARCHAR(20))) AS invoice_id, o_orderkey,
         CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(15 * (1 + o_orderkey % 4) AS INT) END AS due_date,
         CASE WHEN o_orderstatus = 'F' THEN last_ship END AS paid_date,
         s_name AS vendor, c_name AS client, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'UNPAID' END AS status
  FROM orders LEFT JOIN first_line ON o_orderkey = l_orderkey
       LEFT JOIN supplier ON suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey),
contracts AS (
  SELECT concat('CTR-', CAST(s_suppkey AS VARCHAR(20))) AS contract_id, s_suppkey, s_name AS vendor,
         CASE s_suppkey % 4 WHEN 0 THEN 'SERVICE' WHEN 1 THEN 'LICENSE' WHEN 2 THEN 'CONSULTING' ELSE 'SUPPLY' END AS type,
         DATE '2000-01-01' + CAST((s_suppkey * 11) % 300 AS INT) AS start_date,
         CASE WHEN s_suppkey % 17 = 16 THEN NULL
              ELSE DATE '2001-08-15' + CAST((s_suppkey * 37) % 400 - 60 AS INT) END AS end_date,
         CAST(2100000 + 300000 * (s_suppkey % 7) AS DECIMAL(18,2)) AS annual_value,
         s_suppkey % 2 = 0 AS auto_renewal
  FROM supplier),
clause_types AS (SELECT 0 AS k, 'price_revision' AS type UNION ALL SELECT 1, 'penalty'
  UNION ALL SELECT 2, 'termination' UNION ALL SELECT 3, 'exclusivity'),
clauses AS (
  SELECT contract_id, t.type, concat('Clause ', t.type) AS description
  FROM contracts c CROSS JOIN clause_types t WHERE (s_suppkey + k) % 3 <> 0),
edges_generates AS (
  SELECT c.contract_id, i.invoice_id FROM contracts c JOIN invoices i ON lower(trim(c.vendor)) = lower(trim(i.vendor))),
budgets AS (
  SELECT c_mktsegment AS department, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS category,
         CAST(count(*) * 12500 * (15 + (year(o_orderdate) + length(o_orderpriority) + length(c_mktsegment)) % 11) AS DECIMAL(18,2)) AS budget,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS actual
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate), o_orderpriority),
monthly_flows AS (
  SELECT y * 12 + m AS period, m AS month, inflows, outflows, inflows - outflows AS net_cashflow FROM (
    SELECT CAST(year(o_orderdate) - 1995 AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           sum(CAST(o_totalprice AS DECIMAL(18,2))) AS inflows,
           sum(CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS outflows
    FROM orders GROUP BY year(o_orderdate), month(o_orderdate)) f),
predictions AS (
  SELECT concat(department, '/', CAST(year AS VARCHAR(4)), '/', category) AS id,
         CASE WHEN year % 2 = 0 THEN 'budget' ELSE 'contract' END AS entity_type,
         department AS entity_id, 'actual_spend' AS metric, budget AS predicted_value,
         CASE WHEN year < 2001 THEN actual END AS actual_value
  FROM budgets)
"""
