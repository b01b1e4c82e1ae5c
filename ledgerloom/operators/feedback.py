"""Predictions, their outcomes and how good they were."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REINDEX_ABOVE_PCT = 20.0


def error_pct(predicted: Column, actual: Column) -> Column:
    p, a = predicted.cast("double"), actual.cast("double")
    return F.when(F.coalesce(p, F.lit(0.0)) == 0, F.when(a.isNotNull(), 0.0)).otherwise(
        F.abs(a - p) / F.abs(p) * 100)


def append_predictions(stored: DataFrame, new: DataFrame, as_of: dt.date) -> DataFrame:
    """Stored predictions and new open ones, whose id is a hash of what they predict.

    A prediction that is stored already, or comes twice, is added once.
    """
    key = F.concat_ws("|", "entity_type", "entity_id", "metric", F.col("predicted_value").cast("string"),
                      F.lit(str(as_of)))
    fresh = new.select(
        F.md5(key).alias("id"), "entity_type", "entity_id", "metric", "predicted_value",
        F.lit(None).cast(stored.schema["actual_value"].dataType).alias("actual_value"))
    fresh = fresh.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
    return stored.select(*fresh.columns).unionByName(fresh)


def resolve(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Each prediction with its last reported actual, the error and the re-index flag.

    A prediction that ``actuals`` does not name keeps the outcome stored before.
    """
    last = actuals.groupBy(F.col("prediction_id").alias("id")).agg(
        F.max_by("actual_value", "seq").alias("_reported"))
    joined = predictions.join(last, "id", "left").withColumn("actual_value", F.coalesce("_reported", "actual_value"))
    err = error_pct(F.col("predicted_value"), F.col("actual_value"))
    return joined.select(
        "id", "entity_type", "entity_id", "metric", "predicted_value", "actual_value",
        F.round(err, 2).alias("error_pct"), F.coalesce(err > REINDEX_ABOVE_PCT, F.lit(False)).alias("reindexed"))


def accuracy_stats(resolved: DataFrame) -> DataFrame:
    """Count, mean, best and worst error per entity type, best type first."""
    err = F.col("error_pct").cast("decimal(18,2)")
    return (
        resolved.where("error_pct IS NOT NULL").groupBy("entity_type")
        .agg(F.count("*").alias("n"),
             F.round(F.sum(err).cast("double") / F.count("*"), 2).alias("avg_error_pct"),
             F.min("error_pct").alias("best_error_pct"), F.max("error_pct").alias("worst_error_pct"))
        .orderBy("avg_error_pct", "entity_type")
    )


def reindex_queue(resolved: DataFrame) -> DataFrame:
    """One index row per entity that was predicted more than 20 % wrong."""
    wrong = resolved.where("reindexed").select("entity_id").distinct()
    kind = resolved.groupBy("entity_id").agg(F.min_by("entity_type", "id").alias("entity_type"))
    text = F.concat("entity_type", F.lit(" entity "), "entity_id",
                    F.lit(" reindexed after prediction error exceeding 20.0%"))
    return kind.join(wrong, "entity_id", "left_semi").select(
        F.concat(F.lit("reindex_"), "entity_id").alias("doc_id"), "entity_id", "entity_type", text.alias("text"))
