"""A training corpus from raw documents: five stages, each over all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, mixing, quality, shards
from ledgerloom.llm.common import Workspace, remainder, ship, table
from ledgerloom.llm.queries import WEIGHTS, domain


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt from the labelled rows of ``docs``."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels.where(remainder("doc_id", 4) != 2))
    named = docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs
    kept = quality.score(named, weights).where(F.col("score") >= quality.THRESHOLD).drop("score")
    return kept.withColumnRenamed("__score", "score").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return jaccard.keep_one(docs, Workspace(spark, "near"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Workspace(spark, "clean"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, some twice."""
    return mixing.mixed(docs, domain(), WEIGHTS, Workspace(spark, "mix"))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the written shards: slot, shard, byte_offset, doc_ids, n_tokens."""
    ship(spark)
    return shards.materialise(docs, Workspace(spark, "order"))[0]


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", weighted_mix),
    ("training_order", training_order),
]
#: The classifier and the permutation over partitions are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return docs
