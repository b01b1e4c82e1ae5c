"""Names that nearly agree, without comparing all of them.

Two names of lengths m and n reach the ratio t when M = t (m + n) / 2 of their
characters or more match in order. The u = m + n - 2M characters left over part
the matches into u + 1 runs at most, so the names share T = M - (u + 1)(q - 1)
runs of q characters or more, at places no further apart than the longer name has
characters left over. Each name lists its runs, rarest first by how many names
hold them; when T are shared, the first of them stands among the first
(number of runs) - T + 1 on both lists. Names meet there, by run and place, and
no pair is lost for any t and any q with T of at least 1.

Which q lists least differs with the names (a number behind a common word wants
short runs, prose long ones): every pair of lengths takes the q by which the
fewest pairs meet, whatever the place. All of it is joins and sums; what a
hot run lists in common is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 5


def _partners(name: Column, threshold: float) -> Column:
    """For each length a partner may have: (other, matched, spare, drift); pairs that leave no character over are equal names."""
    n = F.length(name)
    least = F.ceil(n * (threshold / (2 - threshold)) - 1e-9).cast("int")
    most = F.floor(n * ((2 - threshold) / threshold) + 1e-9).cast("int")

    def figures(other: Column) -> Column:
        matched = F.ceil((n + other) * (threshold / 2) - 1e-9).cast("int")
        return F.struct(other.alias("other"), matched.alias("matched"), (n + other - 2 * matched).alias("spare"),
                        (F.greatest(n, other) - matched).alias("drift"))

    every = F.transform(F.sequence(F.greatest(least, F.lit(1)), F.greatest(most, F.lit(1))), figures)
    return F.filter(every, lambda p: (p["matched"] <= F.least(n, p["other"])) & (p["spare"] > 0))


def _runs(names: DataFrame) -> DataFrame:
    """(name, q, run, place) of every run of one to ``MOST`` characters."""
    sized = names.select("name", F.explode(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(MOST)))).alias("q"))
    placed = sized.select("name", "q", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("q") + 1)).alias("place"))
    return placed.withColumn("run", F.substring("name", F.col("place"), F.col("q")))


def _lists(names: DataFrame, threshold: float) -> DataFrame:
    """(name, size, other, drift, q, runs): the runs by which a name meets names of one other length, rarest first, with their counts."""
    runs = _runs(names)
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    ranked = runs.join(counts, "run").groupBy("name", "q").agg(F.sort_array(F.collect_list(F.struct("n", "run", "place"))).alias("runs"))
    met = ranked.select("name", "q", "runs", F.explode(_partners(F.col("name"), threshold)).alias("p"))
    shared = F.col("p.matched") - (F.col("p.spare") + 1) * (F.col("q") - 1)
    return met.where(shared >= 1).select(
        "name", F.length("name").alias("size"), "p.other", "p.drift", "q",
        F.slice("runs", 1, F.greatest(F.size("runs") - shared + 1, F.lit(0))).alias("runs"))


def postings(names: DataFrame, threshold: float) -> DataFrame:
    """(size, other, drift, run, place, name): where distinct ``name`` values meet, each pair of lengths by its best run length.

    Lengths that no name has, and pairs of lengths without a run in common, list nothing.
    """
    named = names.where("name <> ''")
    sizes = named.select(F.length("name").alias("other")).distinct()
    listed = _lists(named, threshold).join(sizes, "other", "left_semi").withColumns(
        {"lo": F.least("size", "other"), "hi": F.greatest("size", "other")}).select(
        "lo", "hi", "size", "other", "drift", "q", "name", F.explode("runs").alias("r"))
    # pairs that meet at a run, whatever its place
    met = listed.groupBy("lo", "hi", "q", "r.run").agg(
        F.count_if(F.col("size") == F.col("lo")).alias("a"), F.count_if(F.col("size") == F.col("hi")).alias("b"))
    costs = met.groupBy("lo", "hi", "q").agg(F.sum(F.col("a") * F.col("b")).alias("cost"))
    best = costs.groupBy("lo", "hi").agg(F.min(F.struct("cost", "q")).alias("best")).where("best.cost > 0").select("lo", "hi", "best.q")
    return listed.join(best, ["lo", "hi", "q"]).select("size", "other", "drift", "r.run", "r.place", "name")


def candidates(names: DataFrame, threshold: float, asked: DataFrame | None = None) -> DataFrame:
    """Distinct (name, near) of unequal names whose ratio may reach the threshold; with ``asked`` (some of the names), only theirs."""
    listed = postings(names, threshold)
    mine = listed if asked is None else listed.join(asked.select("name").distinct(), "name", "left_semi")
    spread = mine.select(
        "name", F.col("size").alias("other"), F.col("other").alias("size"), "run",
        F.explode(F.sequence(F.col("place") - F.col("drift"), F.col("place") + F.col("drift"))).alias("place"))
    theirs = listed.select(F.col("name").alias("near"), "size", "other", "run", "place")
    return spread.join(theirs, ["size", "other", "run", "place"]).where("name <> near").select("name", "near").distinct()
