"""Merging by key, partitioned document stores and split-off bad records. Stored keyed tables: ``deltas``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order.

    The rank limit cuts every task's rows to one per key before the shuffle, so
    a key with many versions costs one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def merge_latest(stored: DataFrame, new: DataFrame, keys: list[str], version: list[str] | None = None) -> DataFrame:
    """Stored rows with new ones merged in by key.

    The highest version wins, a new row over a stored one of the same version;
    without versions the new row always wins.
    """
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("_new", F.lit(1)))
    order = [F.desc_nulls_last(v) for v in version or []] + [F.desc("_new")]
    return latest(tagged, keys, order).drop("_new")


def save_documents(docs: DataFrame, path: str, form: str = "json") -> None:
    """Processed documents, one folder per ``document_type``."""
    docs.write.mode("append").partitionBy("document_type").format(form).save(path)


def load_documents(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def split_bad(parsed: DataFrame, corrupt: str = "_corrupt_record", good_when: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and unreadable ones as (source_file, error)."""
    bad = F.col(corrupt).isNotNull()
    if good_when is not None:
        bad = bad | ~F.coalesce(good_when, F.lit(False))
    good = parsed.where(~bad).drop(corrupt)
    failed = parsed.where(bad).select("source_file", F.coalesce(corrupt, F.lit("missing required content")).alias("error"))
    return good, failed


def ingest_stats(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Files read and failed, per document type."""
    ok = documents.groupBy("document_type").agg(
        F.count("*").alias("documents"), F.count_distinct("source_file").alias("files"))
    failed = failures.agg(F.count("*").alias("documents"), F.count_distinct("source_file").alias("files")).select(
        F.lit("failed").alias("document_type"), "documents", "files")
    return ok.unionByName(failed)
