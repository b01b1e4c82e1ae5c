"""Streams of messages and log lines, on Structured Streaming.

Each function takes a streaming DataFrame, so the source may be Kafka, a folder
or anything else; ``kafka_messages`` needs the Kafka package on the classpath.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.deltas import BUCKETS, DeltaTable


def kafka_messages(spark: SparkSession, servers: str, topic: str, schema: str, max_messages: int = 100000) -> DataFrame:
    """Key, decoded value, time and offset of a topic's messages."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_messages).load()
    )
    return decode(raw.withColumn("value", F.col("value").cast("string")).withColumn("key", F.col("key").cast("string")),
                  schema)


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """Messages with their JSON value opened; unreadable ones stay as nulls with their text."""
    return messages.withColumn("data", F.from_json("value", schema))


def without_repeats(messages: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """At-least-once delivery cleaned up; the state holds keys no longer than the delay."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def parse_logs(lines: DataFrame, pattern: str, columns: dict[str, str]) -> DataFrame:
    """Log lines, right-trimmed, with the groups of ``pattern`` as columns of the named types, in order.

    A line that does not follow the pattern keeps its text and has nulls, as has a
    group that is empty or not of its type.
    """
    line = F.rtrim("value")
    parts = [F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).try_cast(kind).alias(name)
             for i, (name, kind) in enumerate(columns.items(), 1)]
    return lines.select(line.alias("line"), *parts)


def daily_totals(messages: DataFrame, time: str, kind: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Count and sum per day and type; a day closes once the watermark has passed it."""
    return (
        messages.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"), kind)
        .agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
        .select(F.col("w.start").alias("day"), kind, "n", "total")
    )


def actuals_meet_predictions(predictions: DataFrame, actuals: DataFrame, horizon: str = "1 day",
                             delay: str = "1 hour") -> DataFrame:
    """Each actual with the prediction it answers, if it came within the horizon.

    ``predictions`` has prediction_id, predicted_at, predicted_value; ``actuals``
    has prediction_id, actual_at, actual_value. Both states are dropped once the
    watermarks rule further matches out.
    """
    p = predictions.withWatermark("predicted_at", delay).alias("p")
    a = actuals.withWatermark("actual_at", delay).withColumnRenamed("prediction_id", "answered").alias("a")
    near = F.expr(f"answered = prediction_id AND actual_at >= predicted_at AND actual_at <= predicted_at + INTERVAL {horizon}")
    return p.join(a, near).select("prediction_id", "predicted_at", "actual_at", "predicted_value", "actual_value")


def predictions_answered_or_lapsed(predictions: DataFrame, actuals: DataFrame, horizon: str = "1 day",
                                   delay: str = "1 hour") -> DataFrame:
    """Every prediction once: with its actual, or without one as soon as none can come any more.

    Columns as for ``actuals_meet_predictions``. An actual that is delivered again
    within the horizon counts once. A prediction goes out with nulls when the
    watermark, the lesser of both streams', has passed its horizon; until then it
    is kept. What arrives behind the watermark is left out: an actual too late for
    the state leaves its prediction lapsed.
    """
    p = predictions.withWatermark("predicted_at", delay)
    a = (actuals.withWatermark("actual_at", delay).dropDuplicatesWithinWatermark(["prediction_id"])
         .withColumnRenamed("prediction_id", "answered"))
    near = F.expr(f"answered = prediction_id AND actual_at >= predicted_at AND actual_at <= predicted_at + INTERVAL {horizon}")
    return p.join(a, near, "leftOuter").select("prediction_id", "predicted_at", "actual_at", "predicted_value", "actual_value")


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything there is, append it to parquet files, stop."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_upsert(stream: DataFrame, table: str, checkpoint: str, keys: list[str], version: list[str],
               after: Callable[[SparkSession, int], None] | None = None, buckets: int = BUCKETS, compact_above: int = 8) -> None:
    """Add every batch to the delta table as a delivery of its own; a replayed batch is in already.

    A batch writes its own rows, whatever the table holds; a bucket is rewritten
    once more than ``compact_above`` deliveries share it. ``after`` is called when
    a batch is in, for work on the refreshed table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        held = DeltaTable(batch.sparkSession, table, stream.schema, keys, version, buckets=buckets)
        held.upsert(batch, f"batch-{batch_id}")
        held.compact(compact_above)
        if after is not None:
            after(batch.sparkSession, batch_id)

    (stream.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
