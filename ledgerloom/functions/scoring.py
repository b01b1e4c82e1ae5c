"""Priority scores. The order of the factors is part of the rounded result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "warning", 2).otherwise(1)


def decision_score(severity: Column, impact: Column, urgency: Column) -> Column:
    raw = severity_weight(severity) * F.greatest(F.lit(0.1), impact) * urgency * 10
    return F.round(raw, 1)


def recommendation_score(impact: Column, urgency: Column, confidence: Column) -> Column:
    raw = (impact * 0.4) + (urgency * 0.4) + (confidence * 0.2)
    return F.round(F.least(F.lit(100.0), raw * 100), 1)


def capped_share(x: Column, full: float) -> Column:
    """Share of ``full``, at most one."""
    return F.least(F.lit(1.0), x.cast("double") / full)
