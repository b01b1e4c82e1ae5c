"""Mixing sources to target weights, in DataFrame functions only.

Sources are leaves of a tree domain - language - source. A token budget goes down
the tree by weight. A node cannot take more than its tokens times the epochs
allowed; what it leaves goes to its siblings by their weights, and only when all
of them are full to the siblings of its ancestors. Each leaf then takes whole
epochs of its documents and, of the next epoch, those documents that start
before its target in an order drawn from seed, epoch and id.

Arithmetic is in whole tokens (128-bit decimals), so the same answer comes out of
any engine. A leaf of any size is cut into steps of its seeded order; step totals
give each document its place without ordering the leaf in one task.

Defined cases: null and empty texts hold no token and are never drawn; a null
domain, language or source is the node "?"; repeated rows are drawn as separate
rows; weights not listed are 1; nothing is drawn from an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace

LEVELS = ["domain", "lang", "source"]
SEED = "mix-1"
#: A leaf gives at most this many epochs.
MOST_EPOCHS = 2
#: Documents a step of the seeded order aims at.
STEP_ROWS = 1024


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Each child's grant out of its parent's ``budget``, limited by ``room``.

    In order of room per weight, a child that could take its share of what is
    left is full, and so are all before it; the others share the rest by weight,
    rounded down, and what rounding leaves goes one token each to the first
    names that have room.
    """
    wide = "decimal(38,0)"
    rows = nodes.withColumn("w", weight.cast(wide)).withColumn("room", F.col("room").cast(wide))
    order = Window.partitionBy(*parent).orderBy(F.col("room").cast("double") / F.col("w").cast("double"), name)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    zero = F.lit(0).cast(wide)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("room").over(ahead), zero)).withColumn(
        "weights", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ahead), zero))
    rows = rows.withColumn("full", F.col("room").cast(wide) * F.col("weights") <= F.col("left") * F.col("w"))
    rows = rows.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(whole), zero)).withColumn(
        "open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    rows = rows.withColumn("part", F.when(F.col("full"), F.col("room")).otherwise(
        F.expr("((budget - spent) * w) div open").cast(wide)))
    rows = rows.withColumn("over", F.col("budget") - F.sum("part").over(whole)).withColumn(
        "turn", F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name)))
    return rows.withColumn("grant", F.col("part") + F.when(
        ~F.col("full") & (F.col("turn") <= F.col("over")) & (F.col("part") < F.col("room")), 1).otherwise(0)).drop(
        "left", "weights", "spent", "open", "part", "over", "turn", "full", "w")


def leaf_targets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 1),
                 epochs: int = MOST_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, target): the grants at the leaves.

    ``leaves`` has the level columns and ``tokens``; the budget is the fraction
    ``share`` of all tokens.
    """
    leaves = leaves.withColumn("room", (F.col("tokens") * epochs).cast("decimal(38,0)"))
    # one window over the leaves: a row per source, not per document
    rows = leaves.withColumn("grant", F.expr(f"cast((sum(tokens) over () * {share[0]}) div {share[1]} as decimal(38,0))"))
    for depth, level in enumerate(LEVELS):
        parent = LEVELS[:depth]
        scope = parent or [F.lit(0)]
        given = weights.get(level, {})
        known = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v))]) if given else None
        weight = F.coalesce(known[F.col(level)], F.lit(1)) if given else F.lit(1)
        at = [*parent, level]
        nodes = rows.groupBy(*at).agg(F.sum("room").alias("room"), F.max("grant").alias("budget"))
        whole = Window.partitionBy(*scope)
        nodes = nodes.withColumn("budget", F.least("budget", F.sum("room").over(whole)))
        if not parent:
            nodes = nodes.withColumn("__root", F.lit(0))
        got = share_out(nodes, parent or ["__root"], level, weight).select(*at, F.col("grant"))
        rows = rows.drop("grant").join(got, at)
    return rows.select(*LEVELS, "tokens", F.col("grant").cast("long").alias("target"))


def draw(documents: DataFrame, domain: Column, weights: dict[str, dict[str, int]], space: Workspace,
         share: tuple[int, int] = (1, 1), epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, key, domain, lang, source, n_tokens, copies): every row's draws, rows without one left out.

    ``share`` is the budget as a fraction of all tokens; ``key`` is md5 of the text.
    """
    def named(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("?"))

    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"),
        named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"),
        n_tokens(F.col("text")).alias("n_tokens"))
    docs = space.keep(docs.where("n_tokens > 0"), "tokens")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = space.keep(leaves, "leaves")
    targets = leaf_targets(leaves.drop("rows"), weights, share, epochs).join(leaves.select(*LEVELS, "rows"), LEVELS)
    targets = space.keep(targets.select(
        *LEVELS, F.expr("cast(target div tokens as int)").alias("full"),
        (F.col("target") % F.col("tokens")).alias("rest"), F.ceil(F.col("rows") / STEP_ROWS).cast("int").alias("steps")), "targets")
    # the prefix of the epoch that is not taken whole
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "key").cast("binary"))
    placed = docs.join(targets, LEVELS).withColumn("place", place)
    placed = placed.withColumn("step", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("steps") / 4294967296))
    steps = placed.groupBy(*LEVELS, "step").agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy(*LEVELS).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*LEVELS, "step", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEVELS, "step").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    got = placed.join(steps, [*LEVELS, "step"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    got = got.withColumn("copies", F.col("full") + (F.col("start") < F.col("rest")).cast("int"))
    return got.where("copies > 0").select("doc_id", "key", *LEVELS, "n_tokens", "copies")


def mixed(documents: DataFrame, domain: Column, weights: dict[str, dict[str, int]], space: Workspace, **how) -> DataFrame:
    """The drawn documents, each as often as it is drawn, with the columns of ``documents``.

    Rows that agree in id, text, domain, language and source share their draws evenly.
    """
    where = ["__id", "__key", "__domain", "__lang", "__source"]
    drawn = draw(documents, domain, weights, space, **how)
    drawn = space.keep(drawn.groupBy(*[F.col(c).alias(f"__{c}") for c in ("key", *LEVELS)], F.col("doc_id").alias("__id")).agg(
        F.sum("copies").alias("__copies")), "drawn")
    keyed = documents.withColumn("__row", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = keyed.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
                        & (F.coalesce(F.col("lang"), F.lit("?")) == F.col("__lang"))
                        & (F.coalesce(F.col("source"), F.lit("?")) == F.col("__source"))
                        & (F.coalesce(domain.cast("string"), F.lit("?")) == F.col("__domain")))
    turn = Window.partitionBy(*where).orderBy(F.lit(0))
    many = Window.partitionBy(*where)
    joined = joined.withColumn("__n", F.count("*").over(many)).withColumn("__i", F.row_number().over(turn))
    times = F.floor((F.col("__copies") + F.col("__n") - F.col("__i")) / F.col("__n")).cast("int")
    return joined.where(times > 0).withColumn("__t", F.explode(F.sequence(F.lit(1), times))).select(*documents.columns)
