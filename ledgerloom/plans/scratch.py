"""Files a plan writes and reads back live under the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ledgerloom.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
