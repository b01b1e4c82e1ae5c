"""Gap-free numbers and first-row choice without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.onerow import attach
from ledgerloom.sources.shared import written_once

#: Where Spark's own row ids change from the partition's number to the place inside it.
PLACE_BITS = 33


def number_rows(rows: DataFrame, order: str, out: str, start: int = 1) -> DataFrame:
    """1, 2, 3, ... in the order of a unique number column.

    Rows are dealt to partitions by ranges of the column, ordered inside each and
    written once with their place, so that no second sample can draw other ranges.
    A partition's rows are counted by its last place; the counts of the ranges
    before, one per partition, are added. As many ranges as the session has shuffle
    partitions (fewer where adaptive execution joins small ones), so a task holds
    about its share whatever the spread of the numbers. Null comes first; equal
    values are numbered in any order; no rows give no rows.
    """
    placed = written_once(
        rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PLACE_BITS).alias("_part")
    inside = F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = placed.groupBy(part).agg((F.max(inside) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", F.shiftright("_place", PLACE_BITS)).join(offsets, "_part")
        .withColumn(out, F.col("_before") + inside + start)
        .drop("_part", "_place", "_before")
    )


def union_renumbered(first: DataFrame, second: DataFrame, order: str, pattern: str = "CTR-%03d") -> DataFrame:
    """Both tables as one; the second's ids go on where the first's count ends.

    ``first`` has contract_id and the columns of ``second`` but for its order.
    """
    numbered = number_rows(second, order, "_no")
    offset = first.agg(F.count("*").alias("_offset"))
    fresh = attach(numbered, offset).withColumn(
        "contract_id", F.format_string(pattern, F.col("_no") + F.col("_offset")))
    return first.unionByName(fresh.select(*first.columns))


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each key; tasks keep one row per key before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
