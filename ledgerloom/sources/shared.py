"""Intermediate tables that several parts of one job read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerloom.session import checkpoint_dir


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the session's shared folder and read back.

    The work behind ``df`` is done once however often the result is used, its
    lineage ends here, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
