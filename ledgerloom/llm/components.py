"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (the larger ones, or the smaller ones and the node) to the least node near it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node.

    Steps repeat until two of them leave the table as it was. A node with any
    number of neighbours costs one row per neighbour; each step's rows are
    written, so a lost executor repeats at most one step.
    """
    def state(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    now = space.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                     f"{name}-0")
    seen, step = state(now), 0
    while True:
        step += 1
        large = space.keep(_star(now, True), f"{name}-{step}-l")
        now = space.keep(_star(large, False), f"{name}-{step}")
        space.drop(f"{name}-{step}-l", f"{name}-{step - 1}")
        after = state(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
