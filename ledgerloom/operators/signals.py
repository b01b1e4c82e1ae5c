"""Small warning signs and the clusters they add up to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.wording import name_or, tenth
from ledgerloom.operators import lookups

# Weight of each sign, and the sum that raises an alert.
SIGNAL_WEIGHTS = {
    "budget_slightly_over": 1,
    "invoice_moderately_overdue": 1,
    "contract_expiring_medium": 1,
    "new_episodic_pattern": 2,
}
STRESS_THRESHOLD = 4

SIGNAL_LIST = "array<struct<type:string,subject:string,signals:bigint,weight:bigint>>"


def _signal(rows: DataFrame, kind: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("type"), subject.alias("subject"), detail.alias("detail"),
        F.lit(SIGNAL_WEIGHTS[kind]).cast("bigint").alias("weight"))


def weak_signals(budgets: DataFrame, invoices: DataFrame, contracts: DataFrame, patterns: DataFrame,
                 as_of: dt.date, include_paid: bool = False) -> DataFrame:
    """Budget 5-15 % over, invoice 15-30 days late, contract 61-90 days from its end, known patterns."""
    over = (F.col("actual") - F.col("budget")).cast("double") / F.col("budget").cast("double") * 100
    b = budgets.where("budget > 0").withColumn("over", over).where("over BETWEEN 5 AND 15")
    late = lookups.days_overdue(as_of)
    i = invoices if include_paid else invoices.where("status = 'UNPAID'")
    i = i.where(F.col("due_date").between(F.date_sub(F.lit(as_of), 30), F.date_sub(F.lit(as_of), 15)))
    c = lookups.contracts_raw(contracts, as_of).where("days_until_expiry BETWEEN 61 AND 90")
    p = patterns.agg(F.count("*").alias("n")).where("n > 0")
    return (
        _signal(b, "budget_slightly_over", name_or("department"),
                F.concat(tenth(F.col("over")), F.lit("% over budget")))
        .unionByName(_signal(i, "invoice_moderately_overdue", name_or("vendor"),
                             F.concat(late.cast("string"), F.lit(" days overdue"))))
        .unionByName(_signal(c, "contract_expiring_medium", name_or("vendor"),
                             F.concat(F.col("days_until_expiry").cast("string"), F.lit(" days until expiry"))))
        .unionByName(_signal(p, "new_episodic_pattern", F.lit("System"),
                             F.concat(F.col("n").cast("string"), F.lit(" learned patterns active"))))
    )


def _fingerprint(member: Column) -> Column:
    """Order-free id of a multiset: digests are added, so no task holds the members."""
    digest = F.conv(F.substring(F.md5(member), 1, 15), 16, 10).cast("decimal(28,0)")
    return F.concat(F.sum(digest).cast("string"), F.lit(":"), F.count("*").cast("string"))


def cluster(signals: DataFrame, as_of: dt.date, known: DataFrame | None = None) -> DataFrame:
    """The company-wide cluster, if the weights reach the threshold and it is new.

    The members stay rows of ``signals``; the cluster carries their number and
    an id that depends on which ``type:subject`` pairs they are and how often.
    """
    member = F.concat_ws(":", "type", "subject")
    found = (
        signals.agg(F.sum("weight").alias("score"), F.count("*").alias("signals"),
                    _fingerprint(member).alias("f"))
        .where(F.col("score") >= STRESS_THRESHOLD)
        .select(F.concat(F.lit("ws_"), F.md5("f")).alias("id"), "score", "signals",
                F.lit(as_of).alias("detected_at"), F.lit(False).alias("acknowledged"))
    )
    return found if known is None else unknown(found, known)


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """The clusters whose id is not stored yet; a cluster that grew has another id and counts as new."""
    return found.join(known.select("id"), "id", "left_anti")


def list_id(names: Column) -> Column:
    """``ws_`` and the MD5 of the sorted names as a JSON list."""
    text = F.concat(F.lit('["'), F.array_join(F.sort_array(names), '", "'), F.lit('"]'))
    return F.concat(F.lit("ws_"), F.md5(text))


def cluster_by_subject(signals: DataFrame, as_of: dt.date) -> DataFrame:
    """The same weights per department or vendor: one row per subject in stress.

    A subject's signals are first counted per type, so its list has at most as
    many entries as there are types.
    """
    per_type = signals.groupBy("subject", "type").agg(
        F.count("*").alias("signals"), F.sum("weight").alias("weight"))
    return (
        per_type.groupBy("subject")
        .agg(
            F.sum("weight").alias("score"),
            F.sum("signals").alias("signals"),
            F.collect_list(F.concat_ws(":", "type", "subject")).alias("names"),
            F.to_json(F.sort_array(F.collect_list(F.struct("type", "subject", "signals", "weight"))))
            .alias("signals_json"),
        )
        .where(F.col("score") >= STRESS_THRESHOLD)
        .select(list_id(F.col("names")).alias("id"), "subject", "score", "signals", "signals_json",
                F.lit(as_of).alias("detected_at"), F.lit(False).alias("acknowledged"))
    )


def active_signals(clusters: DataFrame, only_active: bool = True) -> DataFrame:
    """Stored clusters with their JSON decoded, worst first."""
    if only_active:
        clusters = clusters.where(~F.col("acknowledged"))
    return clusters.select(
        "id", "score", F.from_json("signals_json", SIGNAL_LIST).alias("signals"),
        "detected_at", "acknowledged",
    ).orderBy(F.desc("score"), "id")
