"""Messy amounts, dates and records made from clean columns, cleaned again.

The twin of each query is the clean column, so a pass means the round trip holds
for every row of the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, records, sheets
from ledgerloom.operators import quality
from ledgerloom.plans.catalog import query
from ledgerloom.plans.edge import edge
from ledgerloom.plans.entities import AS_OF, Tables, money
from ledgerloom.plans.scratch import new_folder
from ledgerloom.sources import files

PRICE = "o_totalprice::DECIMAL(18,2)"


def exact(x: str, n: int = 2) -> str:
    """Round half up on the shortest decimal form of a double, all its digits kept, as Spark does."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38,18), {n})::DOUBLE"


def key():
    return F.col("o_orderkey")


def day():
    return F.col("o_orderdate").cast("date")


def total():
    return money("o_totalprice")


def pick(n: int, *choices):
    """One of several texts by ``o_orderkey % n``."""
    out = F.when(key() % n == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(key() % n == i, c)
    return out


def orders(t: Tables):
    return t.spread("orders", "o_orderkey")


def american(c):
    return F.format_number(c, 2)


def european(c):
    return F.translate(american(c), ",.", ".,")


def messy_amount(c):
    return pick(5, american(c), european(c), c.cast("string"), F.concat(american(c), F.lit(" EUR")),
                F.concat(F.lit("€ "), F.translate(american(c), ",.", " ,")))


def messy_date(d):
    day_first, month_first = F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MM/dd/yyyy")
    return pick(6, day_first, F.when(F.day(d) > 12, month_first).otherwise(day_first),
                F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd.MM.yyyy"),
                F.date_format(d, "MMMM d, yyyy"), dates.format_date(d, "french"))




# --------------------------------------------------------------------- amounts


@query("parse_amount", f"SELECT o_orderkey, {PRICE}::DOUBLE AS amount FROM orders", finance=False)
def _(t):
    return orders(t).select("o_orderkey", amounts.parse_amount(messy_amount(total())).alias("amount"))


@query("parse_amount_prefix", f"SELECT o_orderkey, {PRICE}::DOUBLE AS amount FROM orders", finance=False)
def _(t):
    text = pick(3, american(total()), F.concat(total().cast("string"), F.lit(" EUR")), total().cast("string"))
    return orders(t).select("o_orderkey", amounts.parse_amount_prefix(text).alias("amount"))


@query("detect_currency", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' WHEN 4 THEN 'JPY'
                                       WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN 'CHF' ELSE 'EUR' END AS currency
FROM orders""", finance=False)
def _(t):
    a = american(total())
    text = pick(8, F.concat(F.lit("$"), a), F.concat(a, F.lit(" €")), F.concat(F.lit("£"), a),
                F.concat(a, F.lit(" CHF")), F.concat(a, F.lit(" jpy")), F.concat(F.lit("France "), a), F.lit(""),
                F.concat(F.lit("Fr "), a))
    return orders(t).select("o_orderkey", amounts.detect_currency(text).alias("currency"))


@query("parse_tax_rate", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_tax, 2) AS tax_rate FROM lineitem""", finance=False)
def _(t):
    pct = (F.round("l_tax", 2) * 100).cast("decimal(5,1)").cast("string")
    text = F.concat(F.lit("TVA "), pct, F.when(F.col("l_linenumber") % 2 == 0, " %").otherwise("%"))
    return edge(t.read("lineitem").select("l_orderkey", "l_linenumber",
                                          amounts.parse_tax_rate(text).alias("tax_rate")))


@query("extract_amounts", f"""
SELECT o_orderkey, currency, tax_rate, amount_ht, amount_ttc,
       CASE k WHEN 0 THEN {exact('amount_ttc - amount_ht')} WHEN 1 THEN 20.0 ELSE 5.5 END::DOUBLE AS tax_amount
FROM (SELECT o_orderkey, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 3 = 2 THEN 'USD' ELSE 'EUR' END AS currency,
             CASE WHEN o_orderkey % 3 = 2 THEN 0.055 ELSE 0.2 END::DOUBLE AS tax_rate,
             CASE WHEN o_orderkey % 3 = 2 THEN {exact(f"{PRICE}::DOUBLE / (1 + 0.055::DOUBLE)")}
                  ELSE {PRICE}::DOUBLE END AS amount_ht,
             CASE o_orderkey % 3 WHEN 0 THEN {exact(f"{PRICE}::DOUBLE * (1 + 0.2::DOUBLE)")}
                  WHEN 1 THEN ({PRICE} + 100)::DOUBLE ELSE {PRICE}::DOUBLE END AS amount_ttc FROM orders)""",
       finance=False)
def _(t):
    """Net only, net and gross, gross only. "TVA 20%" reads as a tax amount of 20."""
    text = pick(3,
                F.concat(F.lit("Montant HT: "), european(total()), F.lit(" EUR, taux 20%")),
                F.concat(F.lit("Total HT: "), american(total()), F.lit(" EUR, TVA 20%, Total TTC: "),
                         american(total() + 100), F.lit(" EUR")),
                F.concat(F.lit("Amount due: "), american(total()), F.lit(" USD (VAT 5.5%)")))
    return orders(t).select("o_orderkey", amounts.extract_amounts(text).alias("a")).select("o_orderkey", "a.*")


@query("tax_gross_net", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {exact('l_extendedprice * (1 + l_tax)')} AS gross,
       {exact('l_extendedprice / (1 + l_tax)')} AS net FROM lineitem""", finance=False)
def _(t):
    p, r = F.col("l_extendedprice"), F.col("l_tax")
    return edge(t.read("lineitem").select("l_orderkey", "l_linenumber", amounts.gross(p, r).alias("gross"),
                                          amounts.net(p, r).alias("net")))


@query("format_amount", f"""
SELECT o_orderkey, concat(replace(replace(format('{{:,.2f}}', {PRICE}::DOUBLE), ',', ' '), '.', ','), ' EUR') AS fr,
       CASE o_orderkey % 3 WHEN 0 THEN concat('€', format('{{:,.2f}}', {PRICE}::DOUBLE))
            WHEN 1 THEN concat('$', format('{{:,.2f}}', {PRICE}::DOUBLE))
            ELSE concat(format('{{:,.2f}}', {PRICE}::DOUBLE), ' CHF') END AS en FROM orders""", finance=False)
def _(t):
    code = pick(3, F.lit("EUR"), F.lit("USD"), F.lit("CHF"))
    return orders(t).select("o_orderkey", amounts.format_amount(total(), F.lit("EUR"), "fr").alias("fr"),
                            amounts.format_amount(total(), code, "en").alias("en"))


# ----------------------------------------------------------------------- dates


@query("parse_date", """
SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::DATE AS day_us FROM orders""", finance=False)
def _(t):
    us = F.when(key() % 2 == 0, F.date_format(day(), "MM/dd/yyyy")).otherwise(F.date_format(day(), "yyyy/MM/dd"))
    return orders(t).select("o_orderkey", dates.parse_date(messy_date(day())).alias("day"),
                            dates.parse_date(us, prefer_european=False).alias("day_us"))


@query("relative_date", """
SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1))
  WHEN 1 THEN last_day(make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, 1))
  WHEN 2 THEN DATE '2001-08-15' + (o_orderkey % 90)::INT WHEN 3 THEN DATE '2001-08-31'
  ELSE DATE '2001-12-31' END AS day FROM orders""", finance=False)
def _(t):
    y = F.year(day()).cast("string")
    text = pick(5, F.concat(F.lit("Q"), F.quarter(day()).cast("string"), F.lit(" "), y),
                F.concat(F.when(F.month(day()) <= 6, "H1 ").otherwise("h2"), y),
                F.concat(F.lit("Net "), (key() % 90).cast("string"), F.lit(" days")),
                F.lit("end of month"), F.lit("Fin d'année"))
    return orders(t).select("o_orderkey", dates.relative_date(text, AS_OF).alias("day"))


@query("extract_dates", """
SELECT o_orderkey, concat(o_orderdate::DATE::VARCHAR, ',', (o_orderdate::DATE + 30)::VARCHAR) AS found
FROM orders""", finance=False)
def _(t):
    text = F.concat(F.lit("Facture du "), messy_date(day()), F.lit(" à payer avant le "),
                    F.date_format(F.date_add(day(), 30), "dd/MM/yyyy"), F.lit(" réf 2024-1"))
    found = F.transform(dates.extract_dates(text), lambda d: d.cast("string"))
    return orders(t).select("o_orderkey", F.array_join(found, ",").alias("found"))


@query("date_arith", """
SELECT invoice_id, date < due_date AS in_order, (due_date - date)::BIGINT AS days,
       due_date < DATE '2001-08-15' AS overdue FROM invoices""")
def _(t):
    return edge(t.invoices(False, False, False).select(
        "invoice_id", dates.in_order(F.col("date"), F.col("due_date")).alias("in_order"),
        F.datediff("due_date", "date").alias("days"), dates.is_overdue(F.col("due_date"), AS_OF).alias("overdue")))


@query("payment_delay", """
SELECT invoice_id, (paid_date - (date + 30))::BIGINT AS delay_days, paid_date - (date + 30) > 0 AS is_late
FROM invoices WHERE paid_date IS NOT NULL""")
def _(t):
    delay = dates.payment_delay(F.col("date"), F.col("paid_date"), 30)
    return edge(t.invoices(vendor=False, client=False).where("paid_date IS NOT NULL").select(
        "invoice_id", delay.alias("delay_days"), (delay > 0).alias("is_late")))


@query("format_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS european,
       strftime(o_orderdate, '%m/%d/%Y') AS american,
       concat(day(o_orderdate)::VARCHAR, ' ', ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août',
         'septembre', 'octobre', 'novembre', 'décembre'][month(o_orderdate)], ' ', year(o_orderdate)::VARCHAR) AS french
FROM orders""", finance=False)
def _(t):
    return orders(t).select("o_orderkey", *[dates.format_date(day(), s).alias(s)
                                            for s in ("iso", "european", "american", "french")])


@query("fiscal_calendar", """
SELECT o_orderkey, quarter(o_orderdate)::BIGINT AS quarter,
       (year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END)::BIGINT AS fiscal_year
FROM orders""", finance=False)
def _(t):
    return edge(orders(t).select("o_orderkey", F.quarter(day()).alias("quarter"),
                                 dates.fiscal_year(day(), 4).alias("fiscal_year")))


@query("norm_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN DATE '2026-12-31' ELSE o_orderdate::DATE END AS day_first,
       o_orderdate::DATE AS month_first FROM orders""", finance=False)
def _(t):
    dmy = pick(5, F.date_format(day(), "d/M/yyyy"), F.date_format(day(), "dd-MM-yyyy"), F.date_format(day(), "yyyy-MM-dd"),
               F.date_format(day(), "MMMM d, yyyy"), F.lit("upon signature"))
    mdy = pick(3, F.date_format(day(), "M/d/yyyy"), F.date_format(day(), "MM.dd.yyyy"), F.date_format(day(), "d MMMM yyyy"))
    return orders(t).select(
        "o_orderkey", dates.norm_date(dmy, "dmy", dt.date(2026, 12, 31)).alias("day_first"),
        dates.norm_date(mdy, "mdy").alias("month_first"))


# --------------------------------------------------------------------- records


@query("alias_coalesce", f"""
SELECT o_orderkey, {PRICE}::DOUBLE AS amount, 0.2::DOUBLE AS rate, o_orderdate::DATE AS day,
       CASE WHEN o_orderkey % 3 = 0 THEN 30.0 ELSE 45.0 END::DOUBLE AS terms FROM orders""", finance=False)
def _(t):
    aliased = orders(t).select(
        "o_orderkey",
        F.when(key() % 3 == 0, messy_amount(total())).alias("total_ht"), F.when(key() % 3 == 1, american(total())).alias("subtotal"),
        F.when(key() % 3 == 2, total().cast("string")).alias("net_amount"),
        F.when(key() % 2 == 0, "20").alias("tax_rate"), F.when(key() % 2 == 1, "0.2").alias("vat_rate"),
        F.when(key() % 2 == 0, messy_date(day())).otherwise("soon").alias("date"),
        F.date_format(day(), "yyyy-MM-dd").alias("issue_date"),
        F.when(key() % 3 != 0, "45").alias("payment_terms_days"))
    return aliased.select(
        "o_orderkey", records.first_number("total_ht", "subtotal", "net_amount").alias("amount"),
        records.as_fraction(records.first_number("tax_rate", "vat_rate")).alias("rate"),
        records.first_date("date", "issue_date").alias("day"),
        records.first_number("payment_terms_days", default=30).alias("terms"))


@query("party_struct", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'UNKNOWN' ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 IN (1, 2) THEN lpad(c_custkey::VARCHAR, 14, '0') END AS siret FROM customer""",
       finance=False)
def _(t):
    k, name, siret = F.col("c_custkey"), F.col("c_name"), F.lpad(F.col("c_custkey").cast("string"), 14, "0")
    text = (F.when(k % 4 == 0, name)
            .when(k % 4 == 1, F.to_json(F.struct(name.alias("name"), siret.alias("siret"))))
            .when(k % 4 == 2, F.to_json(F.struct(name.alias("company_name"), siret.alias("company_id"))))
            .otherwise("{}"))
    return t.read("customer").select("c_custkey", records.party(text).alias("p")).select(
        "c_custkey", "p.name", "p.siret")


@query("items_normalised", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
       CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'NO DESCRIPTION' END AS description,
       l_quantity AS quantity, l_extendedprice::DECIMAL(18,2)::DOUBLE AS unit_price,
       CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * l_extendedprice::DECIMAL(18,2)::DOUBLE
            ELSE (l_extendedprice::DECIMAL(18,2) + 1)::DOUBLE END AS total FROM lineitem""", finance=False)
def _(t):
    price, even = money("l_extendedprice"), F.col("l_linenumber") % 2 == 0
    item = F.struct(
        F.when(even, F.col("l_returnflag")).alias("description"), F.lit(None).cast("string").alias("label"),
        F.when(even, F.col("l_quantity").cast("string")).alias("quantity"), F.col("l_quantity").cast("string").alias("qty"),
        american(price).alias("unit_price"), F.lit(None).cast("string").alias("price"),
        F.lit(None).cast("string").alias("rate"), F.lit(None).cast("string").alias("total"),
        F.when(~even, american(price + 1)).alias("amount"), F.lit(None).cast("string").alias("subtotal"))
    out = t.spread("lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", F.inline(records.items(F.array(item))))
    return edge(out)


@query("provider_pick", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'Client SA' WHEN 2 THEN s_name
                                     ELSE 'UNKNOWN' END AS provider FROM supplier""", finance=False)
def _(t):
    k, name = F.col("s_suppkey"), F.col("s_name")
    client = F.lit('{"name": "Client SA", "role": "client"}')
    giving = F.to_json(F.struct(name.alias("name"), F.lit("Provider").alias("role")))
    people = (F.when(k % 4 == 0, F.array(client, giving)).when(k % 4 == 1, F.array(F.lit("Client SA"), name))
              .when(k % 4 == 2, F.array().cast("array<string>")))
    vendor = F.when(k % 4 == 2, name)
    return t.read("supplier").select(
        "s_suppkey", records.provider(records.parties(people), vendor).alias("provider"))


@query("derive_totals", f"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN {exact(f"{PRICE}::DOUBLE / (1 + 0.2::DOUBLE)")}
                        ELSE {PRICE}::DOUBLE END AS ht,
       CASE o_orderkey % 3 WHEN 0 THEN {exact(f"{PRICE}::DOUBLE * (1 + 0.2::DOUBLE)")} WHEN 1 THEN {PRICE}::DOUBLE
            ELSE ({PRICE} + 7)::DOUBLE END AS ttc,
       CASE o_orderkey % 3 WHEN 0 THEN {exact(f"{exact(f'{PRICE}::DOUBLE * (1 + 0.2::DOUBLE)')} - {PRICE}::DOUBLE")}
            WHEN 1 THEN {exact(f"{PRICE}::DOUBLE - {exact(f'{PRICE}::DOUBLE / (1 + 0.2::DOUBLE)')}")}
            ELSE 7.0 END::DOUBLE AS tax FROM orders""", finance=False)
def _(t):
    given = total().cast("double")
    ht, ttc = F.when(key() % 3 != 1, given), F.when(key() % 3 == 1, given).when(key() % 3 == 2, (total() + 7).cast("double"))
    full = amounts.complete_totals(ht, F.lit(0.2), ttc, F.lit(0.0))
    return orders(t).select("o_orderkey", full.alias("t")).select("o_orderkey", "t.*")


# ---------------------------------------------------------------------- sheets

QUARTERS = """
, q AS (SELECT c_mktsegment AS department, year(o_orderdate) AS year, o_orderpriority AS category,
               sum(o_totalprice::DECIMAL(18,2)) AS actual, count(*) * 12500 AS budget
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def quarter_sheet(t: Tables):
    """A budget sheet as finance teams keep it: accented headers, messy text, quarters."""
    seg = t.read("customer").select("c_custkey", "c_mktsegment")
    q = F.quarter("o_orderdate")
    sums = [F.sum(F.when(q == i, total())).alias(f"s{i}") for i in range(1, 5)]
    rows = (
        t.read("orders").join(seg, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", F.year("o_orderdate").alias("y"), "o_orderpriority")
        .agg(F.count("*").alias("n"), *sums)
    )
    text = [F.concat(F.format_number(F.coalesce(f"s{i}", F.lit(0)), 2), F.lit(" EUR")).alias(f"Q{i}")
            for i in range(1, 5)]
    return rows.select(
        F.concat(F.lit("budget_"), F.col("y").cast("string")).alias("file"),
        F.col("c_mktsegment").alias("Département"), F.col("o_orderpriority").alias("Catégorie"),
        F.translate(F.format_number(F.col("n") * 12500, 2), ",.", " ,").alias("Budget Annuel"), *text)


@query("budget_sheet_mapped", QUARTERS + """
SELECT department, year::BIGINT AS year, category, budget::DOUBLE AS budget FROM q""")
def _(t):
    """The sheet written as CSV, one folder per year, read back and mapped."""
    folder = new_folder(t.spark, "sheet")
    quarter_sheet(t).write.partitionBy("file").option("header", True).csv(folder)
    names = ["Département", "Catégorie", "Budget Annuel", "Q1", "Q2", "Q3", "Q4"]
    sheet = files.read_named_csv(t.spark, folder, names, ["Département", "Budget Annuel"], folders="file string")
    tidy = sheets.tidy_budget_sheet(sheet, source_file="file")
    year = F.regexp_extract("file", r"(\d{4})", 1).cast("bigint").alias("year")
    return tidy.select("department", year, "category", "budget")


@query("budget_from_quarters", QUARTERS + """
SELECT department, year::BIGINT AS year, category, budget::DOUBLE AS budget, actual::DOUBLE AS actual,
       (actual - budget)::DOUBLE AS variance FROM q""")
def _(t):
    sheet = quarter_sheet(t).withColumn("source_file", F.concat("file", F.lit(".csv"))).drop("file")
    return edge(sheets.budget_rows(sheets.tidy_budget_sheet(sheet)))


@query("header_row", "SELECT o_orderkey, (o_orderkey % 4)::BIGINT AS header_row FROM orders", finance=False)
def _(t):
    """Text tables with none to three title lines above the header."""
    titles = F.array_repeat(F.lit("Grand livre;exercice en cours"), (key() % 4).cast("int"))
    row = F.concat_ws(";", F.date_format(day(), "dd/MM/yyyy"), F.lit("601"), total().cast("string"))
    text = F.array_join(F.concat(titles, F.array(F.lit("Période;Compte;Montant total"), row, row)), "\n")
    return edge(sheets.header_row(orders(t).select("o_orderkey", text.alias("text")), "o_orderkey", "text"))


# ------------------------------------------------------------------ validation


def checked_invoices(t: Tables):
    """Invoices with faults planted by key, each in its own share of the rows."""
    k, amount = F.col("o_orderkey"), F.col("amount").cast("double")
    inv = t.invoices(paid=False)
    ttc = F.when(k % 41 == 0, -amount).when(k % 43 == 0, 0.0).when(k % 47 != 0, amount)
    rate = F.when(k % 31 == 0, 1.5).when(k % 37 == 0, 0.17).otherwise(0.2)
    bad_item = F.struct(F.when(k % 2 == 0, "part").alias("description"), (k % 3 - 1).cast("double").alias("quantity"),
                        F.when(k % 5 == 0, -1.0).otherwise(1.0).alias("unit_price"))
    return inv.select(
        F.when(k % 53 == 0, "I").otherwise(F.col("invoice_id")).alias("invoice_id"), "o_orderkey", "vendor",
        F.when(k % 59 == 0, "").otherwise(F.col("client")).alias("client"), "date",
        F.when(k % 61 == 0, F.date_sub("date", 1)).otherwise(F.col("due_date")).alias("due_date"),
        F.round(F.abs(amount) / 1.2, 2).alias("total_ht"), rate.alias("tax_rate"), ttc.alias("total_ttc"),
        F.array(bad_item).alias("items"))


CHECKED = """
, x AS (SELECT o_orderkey AS k, vendor, date,
               CASE WHEN o_orderkey % 61 = 0 THEN date - 1 ELSE due_date END AS due,
               CASE WHEN o_orderkey % 41 = 0 THEN -amount::DOUBLE WHEN o_orderkey % 43 = 0 THEN 0
                    WHEN o_orderkey % 47 <> 0 THEN amount::DOUBLE END AS ttc,
               round(amount::DOUBLE / 1.2::DOUBLE, 2) AS ht,
               CASE WHEN o_orderkey % 31 = 0 THEN 1.5 WHEN o_orderkey % 37 = 0 THEN 0.17 ELSE 0.2 END::DOUBLE AS rate
        FROM invoices),
judged AS (SELECT k AS o_orderkey,
  concat_ws(',', CASE WHEN vendor IS NULL THEN 'missing_vendor' END, CASE WHEN ttc IS NULL THEN 'missing_total_ttc' END,
    CASE WHEN ttc < 0 THEN 'negative_ttc' END, CASE WHEN rate > 1 THEN 'tax_rate_range' END,
    CASE WHEN due < date THEN 'due_before_date' END, CASE WHEN vendor IS NULL THEN 'vendor_name_missing' END) AS errors,
  concat_ws(',', CASE WHEN k % 53 = 0 THEN 'short_id' END, CASE WHEN ttc = 0 THEN 'zero_ttc' END,
    CASE WHEN abs(round(ht * (1 + rate), 2) - ttc) > 0.1 THEN 'amount_inconsistency' END,
    CASE WHEN rate <> 0.2 THEN 'unusual_rate' END, CASE WHEN k % 59 = 0 THEN 'client_name_missing' END,
    CASE WHEN k % 2 <> 0 THEN 'item_description' END, CASE WHEN k % 3 <= 1 THEN 'item_quantity' END,
    CASE WHEN k % 5 = 0 THEN 'item_price' END) AS warnings FROM x)
"""


@query("validate_invoices", CHECKED + "SELECT o_orderkey, errors = '' AS is_valid, errors, warnings FROM judged")
def _(t):
    judged = quality.validate_invoices(checked_invoices(t))
    return judged.select("o_orderkey", "is_valid", quality.codes("errors").alias("errors"),
                         quality.codes("warnings").alias("warnings"))


@query("validation_summary", CHECKED + """
SELECT count(*)::BIGINT AS total_documents, count(*) FILTER (errors = '')::BIGINT AS valid_count,
       count(*) FILTER (errors <> '')::BIGINT AS invalid_count,
       sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, ',')) END)::BIGINT AS total_errors,
       sum(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END)::BIGINT AS total_warnings FROM judged""")
def _(t):
    return quality.validation_summary(quality.validate_invoices(checked_invoices(t)))


@query("validate_contracts", """
SELECT contract_id, concat_ws(',', CASE WHEN s_suppkey % 7 = 0 THEN 'missing_title' END,
         CASE WHEN end_date < start_date THEN 'end_before_start' END,
         CASE WHEN s_suppkey % 11 = 0 THEN 'negative_amount' END,
         CASE WHEN s_suppkey % 5 = 0 THEN 'no_party' END) AS errors,
       concat_ws(',', CASE WHEN s_suppkey % 13 = 0 AND s_suppkey % 11 <> 0 THEN 'zero_amount' END,
         CASE WHEN s_suppkey % 5 = 1 THEN 'one_party' END, CASE WHEN s_suppkey % 5 IN (1, 2) THEN 'no_roles' END) AS warnings
FROM (SELECT contract_id, s_suppkey, start_date, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1999-01-01' ELSE end_date END AS end_date
      FROM contracts)""")
def _(t):
    k, v = F.col("s_suppkey"), F.col("annual_value").cast("double")
    other = F.lit("Client SA")
    people = (F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.col("vendor")))
              .when(k % 5 == 2, F.array(F.col("vendor"), other))
              .otherwise(F.array(F.to_json(F.struct(F.col("vendor").alias("name"), F.lit("provider").alias("role"))), other)))
    c = t.contracts().select(
        "contract_id", F.when(k % 7 != 0, F.concat(F.col("type"), F.lit(" agreement"))).alias("title"), "start_date",
        F.when(k % 3 == 0, F.lit(dt.date(1999, 1, 1))).otherwise(F.col("end_date")).alias("end_date"),
        F.when(k % 11 == 0, -v).when(k % 13 == 0, 0.0).otherwise(v).alias("amount"),
        records.parties(people).alias("parties"))
    return quality.validate_contracts(c).select(
        "contract_id", quality.codes("errors").alias("errors"), quality.codes("warnings").alias("warnings"))


@query("validate_budgets", """
SELECT department, year::BIGINT AS year, category,
       concat_ws(',', CASE WHEN year = 1996 THEN 'missing_budget' END, CASE WHEN year = 1997 THEN 'negative_budget' END,
                 CASE WHEN year = 1997 OR year = 1998 THEN 'variance_inconsistency' END) AS errors,
       CASE WHEN year = 1999 THEN 'negative_actual' ELSE '' END AS warnings FROM budgets""")
def _(t):
    b, a, y = F.col("budget"), F.col("actual"), F.col("year")
    rows = t.budgets().select(
        "department", "year", "category",
        F.when(y == 1997, -b).when(y != 1996, b).alias("budget"), F.when(y == 1999, -a).otherwise(a).alias("actual"),
        F.when(y == 1998, a - b + 1).when(y == 1999, -a - b).otherwise(a - b).alias("variance"))
    return edge(quality.validate_budgets(rows).select(
        "department", "year", "category", quality.codes("errors").alias("errors"),
        quality.codes("warnings").alias("warnings")))


@query("validate_date_range", """
SELECT contract_id, CASE WHEN end_date < start_date THEN 'end_before_start,negative_range' ELSE '' END AS errors,
       CASE WHEN end_date - start_date > 600 THEN 'range_too_long' ELSE '' END AS warnings FROM contracts""")
def _(t):
    rows = quality.validate_date_range(t.contracts(), "start_date", "end_date", max_days=600)
    return rows.select("contract_id", quality.codes("errors").alias("errors"),
                       quality.codes("warnings").alias("warnings"))


@query("validate_amount_range", """
SELECT invoice_id, CASE WHEN amount < 1000 THEN 'below_minimum' ELSE '' END AS errors,
       CASE WHEN amount > 400000 THEN 'above_maximum' ELSE '' END AS warnings FROM invoices""")
def _(t):
    rows = quality.validate_amount_range(t.invoices(False, False, False), "amount", 1000, 400000)
    return rows.select("invoice_id", quality.codes("errors").alias("errors"),
                       quality.codes("warnings").alias("warnings"))


@query("unique_keys", """
SELECT 'Invoice' AS label, count(*)::BIGINT AS n, count(DISTINCT invoice_id)::BIGINT AS distinct_keys, 0::BIGINT AS repeated_keys FROM invoices
UNION ALL SELECT 'Contract', count(*), count(DISTINCT contract_id), 0 FROM contracts
UNION ALL SELECT 'Budget', count(*), count(*), 0 FROM budgets
UNION ALL SELECT 'Prediction', count(*), count(DISTINCT id), 0 FROM predictions
UNION ALL SELECT 'Client', count(*), count(DISTINCT c_name), 0 FROM customer
UNION ALL SELECT 'Vendor', count(*), count(DISTINCT s_name), 0 FROM supplier
UNION ALL SELECT 'Clause', count(*), count(DISTINCT type), count(DISTINCT type) FROM clauses""")
def _(t):
    """Clauses are keyed by type here on purpose, to show repeated keys."""
    return quality.unique_keys({
        "Invoice": (t.invoices(False, False, False), ["invoice_id"]), "Contract": (t.contracts(), ["contract_id"]),
        "Budget": (t.budgets(), ["department", "year", "category"]), "Prediction": (t.predictions(), ["id"]),
        "Client": (t.read("customer"), ["c_name"]), "Vendor": (t.read("supplier"), ["s_name"]),
        "Clause": (t.clauses(), ["type"])})


@query("validate_required", """
SELECT event_id, concat_ws(',', CASE WHEN NOT contains(props, '"k"') THEN 'k' END, 'user') AS missing FROM events""",
       finance=False)
def _(t):
    missing = quality.missing_fields(F.col("props"), ["k", "user"])
    return t.read("events").select("event_id", F.array_join(missing, ",").alias("missing"))


@query("budget_issues", """
SELECT 'WARNING' AS severity, 'budget' AS "column", 'null_values' AS issue, count(*)::BIGINT AS n FROM budgets WHERE year = 1996
UNION ALL SELECT 'WARNING', 'budget', 'negative_values', count(*) FROM budgets WHERE year = 1997
UNION ALL SELECT 'WARNING', 'department', 'repeated_period', count(*) FROM
  (SELECT department, year FROM budgets GROUP BY department, year HAVING count(*) > 1)""")
def _(t):
    b, y = F.col("budget"), F.col("year")
    return quality.budget_issues(t.budgets().select(
        "department", y.alias("period"), F.when(y == 1997, -b).when(y != 1996, b).alias("budget"), "actual"))
