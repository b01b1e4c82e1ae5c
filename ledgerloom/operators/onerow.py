"""Putting the figures of a one-row table beside every row of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of ``totals``, which holds exactly one row.

    A scalar subquery, so neither side is shuffled or joined; a second row in
    ``totals`` is an error at run time.
    """
    packed = totals.select(F.struct(*totals.columns).alias("_t")).scalar()
    taken = "_totals"
    out = rows.withColumn(taken, packed)
    return out.select(*rows.columns, *[F.col(f"{taken}.{c}").alias(c) for c in totals.columns])
