"""Numbers inside sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """Rounded to a whole number with comma groups: 1,234,568."""
    return F.format_string("%,d", F.round(c, 0).cast("bigint"))


def tenth(c: Column) -> Column:
    """One decimal: 12.3."""
    return F.round(c, 1).cast("decimal(18,1)").cast("string")


def slug(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def name_or(c: str, other: str = "?") -> Column:
    return F.coalesce(F.col(c), F.lit(other))
