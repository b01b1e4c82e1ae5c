"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is worked out once per row.

    Without it an expression that uses a value ten times repeats its whole tree
    ten times, and nested uses grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
