"""Relations between the entities of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bills_pairs(roles: DataFrame, text_id: str) -> DataFrame:
    """Vendor BILLS client, for every vendor and client name of the same text.

    Repeated names are reduced first, so a text adds one row per pair of
    different names however often it repeats them.
    """
    vendors = roles.where("role = 'VENDOR'").select(text_id, F.col("name").alias("vendor")).distinct()
    clients = roles.where("role = 'CLIENT'").select(text_id, F.col("name").alias("client")).distinct()
    return vendors.join(clients, text_id).select(text_id, "vendor", F.lit("BILLS").alias("relation"), "client")
