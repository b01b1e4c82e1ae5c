"""Removal of lines that many sites share.

A line's spread is the number of distinct sites it stands on. Lines that occur
often enough to matter get a HyperLogLog sketch of their sites, merged by
aggregation. An estimate clearly above or below the threshold decides; lines
near it get an exact distinct count. Lines at or above the threshold are removed
wherever they stand.

Defined cases: a null text is kept as null and has no line; blank lines are never
removed; a null site counts as the site "?"; repeated rows are treated alike;
other columns pass through. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace

MOST_SITES = 8
#: Size of a sketch, 2^SKETCH registers: a relative error of about 6.5 %.
SKETCH = 8
#: Estimates within this share of the threshold are near it (three standard errors).
MARGIN = 0.2


def _occurrences(documents: DataFrame, site: str) -> DataFrame:
    """(doc_id, key, site, pos, h) of every line that is not blank."""
    rows = documents.select(
        F.col("doc_id"), F.xxhash64("text").alias("key"), F.coalesce(F.col(site).cast("string"), F.lit("?")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "key", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(documents: DataFrame, space: Workspace, site: str = "source", most_sites: int = MOST_SITES) -> tuple[DataFrame, DataFrame]:
    """(h) of the lines on ``most_sites`` sites or more, and the occurrences of all repeated lines."""
    occurrences = _occurrences(documents, site)
    often = occurrences.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= most_sites).select("h")
    repeated = space.keep(occurrences.join(often, "h"), "repeated")
    spread = space.keep(repeated.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("sites")), "spread")
    clear = spread.where(F.col("sites") > most_sites * (1 + MARGIN)).select("h")
    near = spread.where(F.col("sites").between(most_sites * (1 - MARGIN), most_sites * (1 + MARGIN))).select("h")
    exact = repeated.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").count().where(
        F.col("count") >= most_sites).select("h")
    return space.keep(clear.unionByName(exact), "boilerplate"), repeated


def without_boilerplate(documents: DataFrame, space: Workspace, site: str = "source", most_sites: int = MOST_SITES) -> DataFrame:
    """``documents`` with the shared lines taken out of ``text``, and n_lines, n_removed (columns of these names are replaced)."""
    documents = documents.drop("n_lines", "n_removed")
    shared, repeated = boilerplate(documents, space, site, most_sites)
    gone = repeated.join(shared, "h", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("pos").alias("__gone"))
    gone = space.keep(gone.withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__of"), "gone")
    keyed = documents.withColumn("__key", F.xxhash64("text"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in documents.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")).withColumn(
        "n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
