"""Exact quantiles and tail measures of a numeric column of any size.

Mergeable sketches name two values around each wanted rank, one pass counts
exactly what lies below, at and between those values, and where too much lies
between them it is bracketed again. Only the values between the last brackets,
at most ``MOST_INSIDE`` rows each, are put in order; a value repeated any number
of times is a piece of its own and one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.onerow import attach

#: Rows that one task may put in order.
MOST_INSIDE = 1 << 18
#: Size of a sketch, and how far from the wanted share its two values are taken: some six times its usual error.
SKETCH, MARGIN = 4096, 0.004
#: Sketches are merged in this many groups before they meet in one task.
MERGERS = 64


def _values(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))


def _piece(v: Column, cuts: list[float]) -> Column:
    """Odd numbers are the cut values themselves, even ones what lies between them, in order."""
    out = F.lit(0)
    for c in cuts:
        out = out + (v > c).cast("int") + (v >= c).cast("int")
    return out


def _sketched(rows: DataFrame) -> DataFrame:
    """One sketch for every piece; each task sends one per piece."""
    some = rows.groupBy("piece", F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m")).agg(
        F.kll_sketch_agg_double("v", SKETCH).alias("sketch"))
    return some.groupBy("piece").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def brackets(df: DataFrame, column: str, shares: list[float], most_inside: int = MOST_INSIDE) -> tuple[int, list[float], dict[int, tuple[int, int]]]:
    """How many values there are, cut values, and of each piece between or at them that holds a wanted rank (rows before it, rows in it).

    A piece between two cuts holds at most ``most_inside`` rows. Two narrow passes
    a round; a round leaves about a hundredth of a piece, and two numbers per rank
    travel to the driver.
    """
    values = _values(df, column)
    cuts: list[float] = []
    total = values.count()
    wanted = sorted({r for p in shares for r in _ranks(total, p)}) if total else []
    held = {0: (0, total)} if total else {}
    while True:
        full = [i for i, (_, n) in held.items() if i % 2 == 0 and n > most_inside]
        if not full:
            return total, cuts, held
        piece = _piece(F.col("v"), cuts)
        sketches = _sketched(values.select("v", piece.alias("piece")).where(F.col("piece").isin(full)))
        ends = {i: sorted({min(1.0, max(0.0, (r - held[i][0]) / held[i][1] + d)) for r in wanted
                           if held[i][0] <= r < sum(held[i]) for d in (-MARGIN, MARGIN)}) for i in full}
        values_at = [F.when(F.col("piece") == i, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, at)))) for i, at in ends.items()]
        found = sketches.select(F.coalesce(*values_at).alias("q")).collect()
        cuts = sorted({*cuts, *(q for row in found for q in row.q)})
        counts = dict(map(tuple, values.groupBy(_piece(F.col("v"), cuts).alias("piece")).count().collect()))
        held, before = {}, 0
        for i in sorted(counts):
            if any(before <= r < before + counts[i] for r in wanted):
                held[i] = (before, counts[i])
            before += counts[i]


def _ranks(total: int, share: float) -> tuple[int, int]:
    rank = (total - 1) * share
    return math.floor(rank), math.ceil(rank)


def percentiles(df: DataFrame, column: str, shares: list[float], most_inside: int = MOST_INSIDE) -> DataFrame:
    """One row with the linearly interpolated percentiles ``p<100 * share>``; nulls and NaN are left out, without values all are null."""
    total, cuts, held = brackets(df, column, shares, most_inside)
    if not held:
        return _values(df, column).agg(*[F.max("v").alias(name_of(p)) for p in shares])
    piece = _piece(F.col("v"), cuts)
    counts = (_values(df, column).select("v", piece.alias("piece")).where(F.col("piece").isin(list(held)))
              .groupBy("piece", "v").agg(F.count("*").alias("c")))
    before = F.element_at(F.create_map(*[F.lit(x) for i, (offset, _) in held.items() for x in (i, offset)]), F.col("piece"))
    upto = Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("last", before + F.sum("c").over(upto) - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank: int) -> Column:
        return F.max(F.when(F.lit(rank).between(F.col("first"), F.col("last")), F.col("v")))

    out = []
    for p in shares:
        low, high = _ranks(total, p)
        out.append((at(low) + (at(high) - at(low)) * F.lit((total - 1) * p - low)).alias(name_of(p)))
    return ranked.agg(*out)


def name_of(share: float) -> str:
    return f"p{round(share * 100)}"


def summary(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Mean, population deviation, ends, percentiles and the share above zero."""
    x = F.col(column).cast("double")
    basics = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                    F.min(x).alias("min"), F.max(x).alias("max"),
                    F.avg((x > 0).cast("double")).alias("probability_positive"))
    return attach(basics, percentiles(df, column, shares))


def tail_risk(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """Value at risk and the mean of what lies at or below it."""
    limit = percentiles(df, column, [1 - confidence]).toDF("var")
    x = F.col(column).cast("double")
    below = attach(df.select(x.alias("x")), limit).where(F.col("x") <= F.col("var"))
    return below.agg(F.max("var").alias("var"), F.avg("x").alias("cvar"))
