"""Finance entities built from the order, line, party and segment tables.

A user with real tables passes DataFrames of the same columns to the operators
instead. Everything here is lazy; callers name the invoice columns they need so
that unused joins never enter the plan.
"""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written_once

AS_OF = dt.date(2001, 8, 15)

CLAUSE_TYPES = ["price_revision", "penalty", "termination", "exclusivity"]
CONTRACT_TYPES = ["SERVICE", "LICENSE", "CONSULTING", "SUPPLY"]


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


class Tables:
    """Lazy access to the given parquet tables and the entities over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query read: made and written once."""
        if name not in self._kept:
            self._kept[name] = written_once(make(), name)
        return self._kept[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for row-wise work that costs more than moving the row.

        Only a scan with fewer splits than there are cores is shuffled, to one
        part per core; a big table has splits enough and stays where it is.
        """
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

    def invoices(self, vendor: bool = True, client: bool = True, paid: bool = True) -> DataFrame:
        orders = self.read("orders")
        day = F.col("o_orderdate").cast("date")
        due = F.when(
            F.col("o_orderkey") % 29 != 0,
            F.date_add(day, (15 * (1 + F.col("o_orderkey") % 4)).cast("int")),
        )
        inv = orders.select(
            F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
            "o_orderkey",
            "o_custkey",
            day.alias("date"),
            due.alias("due_date"),
            money("o_totalprice").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("UNPAID").alias("status"),
        )
        keep = ["invoice_id", "o_orderkey", "date", "due_date"]
        if vendor or paid:
            first_line = self.read("lineitem").groupBy("l_orderkey").agg(
                F.min("l_suppkey").alias("suppkey"),
                F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
            )
            inv = inv.join(first_line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        if paid:
            inv = inv.withColumn("paid_date", F.when(F.col("status") == "PAID", F.col("last_ship")))
            keep.append("paid_date")
        if vendor:
            names = self.read("supplier").select("s_suppkey", F.col("s_name").alias("vendor"))
            inv = inv.join(names, F.col("suppkey") == F.col("s_suppkey"), "left")
            keep.append("vendor")
        if client:
            names = self.read("customer").select("c_custkey", F.col("c_name").alias("client"))
            inv = inv.join(names, F.col("o_custkey") == F.col("c_custkey"), "left")
            keep.append("client")
        return inv.select(*keep, "amount", "status")

    def contracts(self) -> DataFrame:
        key = F.col("s_suppkey")
        kinds = F.array(*[F.lit(t) for t in CONTRACT_TYPES])
        return self.read("supplier").select(
            F.concat(F.lit("CTR-"), key.cast("string")).alias("contract_id"),
            "s_suppkey",
            F.col("s_name").alias("vendor"),
            F.element_at(kinds, (key % 4).cast("int") + 1).alias("type"),
            F.date_add(F.lit(dt.date(2000, 1, 1)), ((key * 11) % 300).cast("int")).alias("start_date"),
            F.when(
                key % 17 != 16,
                F.date_add(F.lit(AS_OF), ((key * 37) % 400 - 60).cast("int")),
            ).alias("end_date"),
            money(F.lit(2100000) + 300000 * (key % 7)).alias("annual_value"),
            (key % 2 == 0).alias("auto_renewal"),
        )

    def clauses(self) -> DataFrame:
        kinds = F.array(*[F.lit(t) for t in CLAUSE_TYPES])
        return (
            self.contracts()
            .select("contract_id", "s_suppkey", F.posexplode(kinds).alias("k", "type"))
            .where((F.col("s_suppkey") + F.col("k")) % 3 != 0)
            .select("contract_id", "type", F.concat(F.lit("Clause "), "type").alias("description"))
        )

    def edges_generates(self, invoices: DataFrame | None = None) -> DataFrame:
        from ledgerloom.operators.links import match_by_vendor

        return match_by_vendor(self.contracts(), invoices or self.invoices(client=False, paid=False))

    def client_contracts(self, invoices: DataFrame | None = None) -> DataFrame:
        """Which client signed which contract: seen through the invoices they share."""
        from ledgerloom.operators.links import vendor_key

        seen = invoices or self.invoices(paid=False)
        pairs = seen.where("client IS NOT NULL").select("client", vendor_key("vendor").alias("k")).distinct()
        return (
            pairs.join(self.contracts().select("contract_id", vendor_key("vendor").alias("k")), "k")
            .select("client", "contract_id")
            .distinct()
        )

    def budgets(self) -> DataFrame:
        seg = self.read("customer").select("c_custkey", "c_mktsegment")
        year = F.year("o_orderdate")
        spend = (
            self.read("orders")
            .join(seg, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.col("c_mktsegment").alias("department"),
                year.alias("year"),
                F.col("o_orderpriority").alias("category"),
            )
            .agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("actual"))
        )
        factor = 15 + (F.col("year") + F.length("category") + F.length("department")) % 11
        return spend.select(
            "department", "year", "category",
            money(F.col("n") * 12500 * factor).alias("budget"),
            money("actual").alias("actual"),
        )

    def monthly_flows(self) -> DataFrame:
        amount = money("o_totalprice")
        y, m = (F.year("o_orderdate") - 1995), F.month("o_orderdate")
        return (
            self.read("orders")
            .groupBy((y * 12 + m).alias("period"), m.alias("month"))
            .agg(
                F.sum(amount).alias("inflows"),
                F.sum(F.when(F.col("o_orderkey") % 10 < 9, amount)).alias("outflows"),
            )
            .withColumn("net_cashflow", F.col("inflows") - F.col("outflows"))
        )

    def predictions(self) -> DataFrame:
        return self.budgets().select(
            F.concat_ws("/", "department", F.col("year").cast("string"), "category").alias("id"),
            F.when(F.col("year") % 2 == 0, "budget").otherwise("contract").alias("entity_type"),
            F.col("department").alias("entity_id"),
            F.lit("actual_spend").alias("metric"),
            F.col("budget").alias("predicted_value"),
            F.when(F.col("year") < 2001, F.col("actual")).alias("actual_value"),
        )
