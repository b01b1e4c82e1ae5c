"""Similarity search over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.bind import let

INLINE_QUERIES = 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; null for the zero vector."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def profile(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    return vectors.select("vec_id", F.size(v).alias("dimension"), F.round(norm(v), 4).alias("norm"))


def centroids(vectors: DataFrame, group: str, dimension: int) -> DataFrame:
    """Mean vector per group, added up on the map side."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dimension)]
    return vectors.groupBy(group).agg(F.array(*means).alias("embedding"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, inline_queries: int = INLINE_QUERIES) -> DataFrame:
    """The ``k`` most similar vectors per query, whatever the number of queries.

    ``queries`` has query_id and embedding. They are put into tiles of about
    ``inline_queries`` each by a hash of their id. One tile travels to the
    vectors as a scalar (its size is that of one tile); with more tiles, vectors
    and tiles meet in an equi-join on the tile number. Either way the ranking is
    cut to ``k`` inside each task before anything is shuffled by query.
    """
    asked = queries.select("query_id", unit(F.col("embedding")).alias("q")).where("q IS NOT NULL")
    n = asked.count()  # the size check that decides between the two ways
    stored = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    packed = F.collect_list(F.struct("query_id", "q")).alias("qs")
    if n <= inline_queries:
        together = stored.withColumn("qs", asked.agg(packed).scalar())
    else:
        tiles = -(-n // inline_queries)
        tile = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).alias("tile")
        per_tile = asked.select("query_id", "q", tile).groupBy("tile").agg(packed)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile")
        together = stored.select("*", every).join(per_tile, "tile")
    scored = together.select("vec_id", "v", F.inline("qs")).select(
        "query_id", "vec_id", dot(F.col("q"), F.col("v")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def add_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored vectors with the new ones added or put in place of the same ``doc_id``."""
    from ledgerloom.sources.sinks import merge_latest

    return merge_latest(stored, new, ["doc_id"])
