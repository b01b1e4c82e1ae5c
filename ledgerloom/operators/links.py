"""Joins along contract, invoice, clause, client and vendor relations.

A vendor may own a third of all invoices, so each side is reduced to one row
per key before it meets the other wherever the answer is an aggregate. Where
the rows themselves are the answer, the join stays an equi-join that adaptive
execution can split.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vendor_key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def match_by_vendor(contracts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Contract-invoice pairs of the same vendor, case and outer blanks aside."""
    c = contracts.select("contract_id", vendor_key("vendor").alias("k")).where("k IS NOT NULL")
    i = invoices.select("invoice_id", vendor_key("vendor").alias("k")).where("k IS NOT NULL")
    return i.join(c, "k").select("contract_id", "invoice_id")


def link_by_vendor(contracts: DataFrame, invoices: DataFrame, existing: DataFrame) -> DataFrame:
    """The pairs of :func:`match_by_vendor` that are not edges yet."""
    return match_by_vendor(contracts, invoices).join(
        existing.select("contract_id", "invoice_id"), ["contract_id", "invoice_id"], "left_anti")


def link_by_id(wanted: DataFrame, contracts: DataFrame, invoices: DataFrame, existing: DataFrame) -> DataFrame:
    """Asked-for edges whose two ends exist and which are not there yet."""
    return (
        wanted.select("contract_id", "invoice_id").distinct()
        .join(contracts.select("contract_id"), "contract_id", "left_semi")
        .join(invoices.select("invoice_id"), "invoice_id", "left_semi")
        .join(existing.select("contract_id", "invoice_id"), ["contract_id", "invoice_id"], "left_anti")
        .select("contract_id", "invoice_id")
    )


def contracts_by_clause(contracts: DataFrame, clauses: DataFrame, clause_type: str) -> DataFrame:
    hit = clauses.where(F.col("type") == clause_type).select(
        "contract_id", F.col("description").alias("clause_description"))
    return contracts.join(hit, "contract_id").select("contract_id", "vendor", "clause_description")


def payment_patterns(signed: DataFrame, edges: DataFrame, invoices: DataFrame) -> DataFrame:
    """Payment delay of each client's contracts: mean, sample deviation, ends, count.

    Client to contract to invoice would repeat every invoice for every client
    of its contract. The delays are whole days, so their count, sum, sum of
    squares and ends per contract are exact and small; only those meet the
    clients.
    """
    days = F.datediff("paid_date", "due_date").cast("bigint")
    paid = invoices.where(F.col("status") == "PAID").select("invoice_id", days.alias("d"))
    per_contract = (
        edges.join(paid, "invoice_id")
        .groupBy("contract_id")
        .agg(
            F.count("*").alias("rows"),
            F.count("d").alias("n"),
            F.sum("d").alias("s"),
            F.sum((F.col("d") * F.col("d")).cast("decimal(20,0)")).alias("ss"),
            F.min("d").alias("lo"),
            F.max("d").alias("hi"),
        )
    )
    total = (
        signed.join(per_contract, "contract_id")
        .groupBy("client")
        .agg(F.sum("rows").alias("total_invoices"), F.sum("n").alias("n"), F.sum("s").alias("s"),
             F.sum("ss").alias("ss"), F.min("lo").alias("min_delay"), F.max("hi").alias("max_delay"))
    )
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    mean = F.try_divide(s, n)
    spread = F.try_divide(F.col("ss").cast("double") - s * mean, n - 1)
    return total.select("client", mean.alias("avg_delay_days"), F.sqrt(spread).alias("delay_stddev"),
                        "min_delay", "max_delay", "total_invoices")


def contract_with_invoices(contracts: DataFrame, edges: DataFrame, invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """A row for each contract and invoice; a contract without invoices has one row with nulls.

    The grain is the same for one invoice and for millions; a hot contract is many
    rows, which nothing collects.
    """
    detail = invoices.select(
        "invoice_id", "amount", "status",
        F.coalesce(F.datediff(F.lit(as_of), F.col("due_date")), F.lit(0)).alias("days_overdue"))
    billed = edges.select("contract_id", "invoice_id").join(detail, "invoice_id")
    return contracts.select("contract_id", "vendor", "annual_value").join(billed, "contract_id", "left")


def invoices_in_pages(rows: DataFrame, edges: DataFrame, page_size: int) -> DataFrame:
    """The rows of :func:`contract_with_invoices` as lists in the order of their ids, with their number and sum.

    One list per contract would put a hot contract's invoices into a single row, so
    they are spread over ``ceil(n / page_size)`` pages by a hash of their id. A
    contract without invoices keeps one page with an empty list.
    """
    pages = edges.groupBy("contract_id").agg(F.ceil(F.count("*") / page_size).alias("pages"))
    hashed = F.conv(F.substring(F.md5("invoice_id"), 1, 8), 16, 10).cast("bigint")
    page = F.when((F.col("pages") > 1) & F.col("invoice_id").isNotNull(), hashed % F.col("pages")).otherwise(F.lit(0))
    item = F.struct("invoice_id", "amount", "status", "days_overdue")
    return (
        rows.join(pages, "contract_id", "left")
        .groupBy("contract_id", "vendor", "annual_value", page.cast("bigint").alias("page"))
        .agg(F.count("invoice_id").alias("invoices"),
             F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"),
             F.sort_array(F.collect_list(F.when(F.col("invoice_id").isNotNull(), item))).alias("items"))
    )


def vendor_summary(contracts: DataFrame, invoices: DataFrame, patterns: DataFrame) -> DataFrame:
    """Contracts, invoices and pattern texts per vendor.

    ``*_distinct`` add equal amounts once, the plain totals add every row.
    """
    zero = F.lit(0).cast("decimal(28,2)")
    c = contracts.where("vendor IS NOT NULL").groupBy("vendor").agg(
        F.count_distinct("contract_id").alias("contract_count"),
        F.sum("annual_value").alias("total_contract_value"),
        F.sum_distinct("annual_value").alias("total_contract_value_distinct"))
    i = invoices.where("vendor IS NOT NULL").groupBy("vendor").agg(
        F.count_distinct("invoice_id").alias("invoice_count"),
        F.sum("amount").alias("total_invoiced"),
        F.sum_distinct("amount").alias("total_invoiced_distinct"))
    # at most one row per pattern type and subject
    p = patterns.groupBy(F.col("subject").alias("vendor")).agg(
        F.sort_array(F.collect_set("description")).alias("patterns"))
    both = c.join(i, "vendor", "full_outer").join(p, "vendor", "left")
    filled = [F.coalesce(x, F.lit(0)).alias(x) for x in ("contract_count", "invoice_count")]
    sums = [F.coalesce(x, zero).alias(x) for x in (
        "total_contract_value", "total_contract_value_distinct", "total_invoiced", "total_invoiced_distinct")]
    return both.select("vendor", *filled, *sums,
                       F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))


def vendor_picture(contracts: DataFrame, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Contracts with the number of invoices they generated and their vendor's patterns."""
    n = edges.groupBy("contract_id").agg(F.count("*").alias("invoices"))
    p = patterns.groupBy(F.col("subject").alias("vendor")).agg(
        F.sort_array(F.collect_set("type")).alias("pattern_types"))
    return (
        contracts.select("contract_id", "vendor")
        .join(n, "contract_id", "left")
        .join(p, "vendor", "left")
        .select("vendor", "contract_id", F.coalesce("invoices", F.lit(0)).alias("invoices"),
                F.coalesce("pattern_types", F.array().cast("array<string>")).alias("pattern_types"))
    )
