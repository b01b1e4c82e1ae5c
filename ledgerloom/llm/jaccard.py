"""Exact similarity join of word-shingle sets by a size-aware heavy-light plan, as components.

A document's set holds hashes of its distinct five-word shingles. Equal sets are
one node. Two nodes link when their Jaccard similarity reaches the threshold.

*Light* sets (size up to a boundary) are looked up by enumerated subsets: of two
light sets with larger size b, both contain a common subset of ceil(0.75 b)
shingles, so each set offers all its subsets of that size for every b it can
meet. *Heavy* sets scan inverted lists: in any one order of shingles, two linked
sets share a shingle among their first n - ceil(0.75 n) + 1. The order puts
shingles that a count sketch calls frequent last, which keeps lists short; it
only shifts cost, never results. Light sets large enough to meet a heavy one are
listed as well. The boundary is where the cost from the size counts is least.

Lists are resolved without all pairs: members are compared with two pivots of the
list, linked nodes become components, members of lists that still hold several
are compared with more pivots, and only what then is in different components is
compared in full. A bound from sizes and listed
shingles leaves out pairs that cannot link; the others are checked on whole sets.

Defined cases: a null, empty or blank text has the empty set, size 0 and links
with nothing; fewer than five words form one shingle; a null id neither names a
component nor loses its row (its component may be named by another row, else
null); repeated rows share a node. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.components import components

WORDS = 5
SHARE = 75  # percent of the union that must be common
#: Counters of the sketch that orders shingles: bounded memory, a table of one byte each reaches the tasks.
SKETCH_BITS = 21
BLOCK = 1 << 14
#: Sets larger than this are never enumerated.
MOST_LIGHT = 10
#: Entries a list bucket aims at and a task packs at once; shingles estimated at as many are dealt over SALTS buckets.
BUCKET = 1 << 18
SALTS = 64
#: Rows of a batch between Spark and Python: texts, sets and pairs with both sets.
BATCH_ROWS = 1024
#: Rounds that compare members of lists still split with this many pivots of the list.
ROUNDS, PIVOTS = 1, 8
#: Members of a long list that one task compares with as many others.
TILE = 192


def shingle_sets(texts: C.Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = C.word_bounds(texts)
    words = C.run_hashes(C.lower_ascii(texts.data), starts, ends)
    out = []
    with np.errstate(over="ignore"):
        if len(words) >= WORDS:
            rolling = sum(words[j: len(words) - WORDS + 1 + j] * C.PLACE[j] for j in range(WORDS))
            rolling = C.mix(rolling)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(rolling[a: b - WORDS + 1]))
            elif b > a:
                whole = (words[a:b] * C.PLACE[8: 8 + b - a]).sum(dtype=np.uint64)
                out.append(C.mix(np.array([whole + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; -1 is kept for the empty set."""
    if not len(s):
        return -1
    name = C.mix(C.mix(s + np.uint64(99)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(name.view(np.int64)[0])


def least_common(n: int) -> int:
    """Shingles that a linked partner shares with the larger, of size n."""
    return -(-SHARE * n // 100)


def most_partner(n: int) -> int:
    return 100 * n // SHARE


# ------------------------------------------------------------------ first pass

def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its node, size and least shingle; at the end the task's sketch in blocks."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    seen: set[int] = set()
    names = ["doc_id", "key", "node", "n", "lead", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        nodes, sizes, leads, pending = [], [], [], []
        for texts in C.text_chunks(batch.column("text")):
            for s in shingle_sets(texts):
                node = node_of(s)
                nodes.append(node)
                sizes.append(len(s))
                leads.append(int(s[:1].view(np.int64)[0]) if len(s) else None)
                if node not in seen:
                    pending.append(s)
                    if len(seen) < 1_000_000:  # a saving only: a set met again would be counted again
                        seen.add(node)
        if pending:
            at = np.concatenate(pending) >> np.uint64(64 - SKETCH_BITS)
            counts += np.bincount(at.astype(np.int64), minlength=len(counts)).astype(np.int32)
        none = pa.nulls(batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(nodes, kinds[2]), pa.array(sizes, kinds[3]),
             pa.array(leads, kinds[4]), none, pa.nulls(batch.num_rows, pa.binary())], names)
    for b in range(len(counts) // BLOCK):
        part = counts[b * BLOCK: (b + 1) * BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, k) for k in kinds[:5]] + [pa.array([b], kinds[5]), pa.array([zlib.compress(part.tobytes(), 1)], kinds[6])], names)


def _levels(described: DataFrame) -> np.ndarray:
    """One byte per counter: 0 for ordinary shingles, then the doublings above; +128 where a list is dealt out."""
    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in rows["counts"]:
            total += np.frombuffer(zlib.decompress(part.as_buffer()), np.int32)
        return pa.table({"block": rows["block"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = described.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(
        add, "block int, counts binary").toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, part in zip(parts["block"].to_pylist(), parts["counts"].to_pylist()):
        counts[block * BLOCK: (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(part), np.int64)
    mean = counts.mean()
    usual = mean + 8 * np.sqrt(mean) + 24
    level = np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 7).astype(np.uint8)
    return level + np.where(counts > BUCKET, 128, 0).astype(np.uint8)


def _boundary(described: DataFrame) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    A list scan costs its entries and, for each, the sets of a fitting size that
    share a shingle, estimated as sets over distinct least shingles.
    """
    rows = described.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").agg(
        F.approx_count_distinct("node").alias("sets"), F.approx_count_distinct("lead").alias("leads")).collect()
    sets, leads = {r.n: r.sets for r in rows}, {r.n: max(1, r.leads) for r in rows}
    best, at = None, 0
    for x in range(MOST_LIGHT + 1):
        cost = 0.0
        for n, m in sets.items():
            if n <= x:
                cost += m * sum(comb(n, least_common(b)) for b in range(n, min(x, most_partner(n)) + 1))
            if most_partner(n) > x:
                cost += m * (n - least_common(n) + 1) * (1 + sets[n] / leads[n])
        if best is None or cost < best:
            best, at = cost, x
    return at


# ----------------------------------------------------------------- second pass

def _subset_keys(s: np.ndarray, boundary: int) -> list[np.ndarray]:
    """A hash for every subset the light set offers."""
    n, out = len(s), []
    with np.errstate(over="ignore"):
        for b in range(n, min(boundary, most_partner(n)) + 1):
            c = least_common(b)
            picks = np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)
            keys = C.mix(s + np.uint64(1234567))[picks].sum(1, dtype=np.uint64)
            out.append(C.mix(keys + np.uint64(b) * C.PLACE[5]))
    return out


def _entries(levels, boundary: int, buckets: int):
    """Signatures of all sets as packed blocks: of a bucket the tokens, for each its place among the block's nodes and sizes."""
    names = ["bucket", "tokens", "which", "nodes", "sizes"]

    def flush(tokens, nodes, sizes, salted):
        sizes = np.array(sizes, np.int64)
        counts = np.array([len(t) for t in tokens])
        token = np.concatenate(tokens)
        node = np.repeat(np.array(nodes, np.int64), counts)
        size = np.repeat(sizes, counts).astype(np.int32)
        deal = np.concatenate(salted)
        bucket = np.where(deal, buckets + (node % SALTS), (token % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        bucket, token, node, size = bucket[order], token[order], node[order], size[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        end = np.append(at[1:], len(bucket))
        columns = [[], [], [], []]
        for a, b in zip(at.tolist(), end.tolist()):
            names_here, where, which = np.unique(node[a:b], return_index=True, return_inverse=True)
            for column, values in zip(columns, (token[a:b], which.astype(np.uint32), names_here, size[a:b][where])):
                column.append(values.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[at], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = levels.value, set()
        tokens, nodes, sizes, salted, held = [], [], [], [], 0
        for batch in batches:
            for texts in C.text_chunks(batch.column("text")):
                for s in shingle_sets(texts):
                    n, node = len(s), node_of(s)
                    if not n or node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    picked, deal = [], []
                    if n <= boundary:
                        for keys in _subset_keys(s, boundary):
                            picked.append(keys)
                            deal.append(np.zeros(len(keys), bool))
                    if most_partner(n) > boundary:
                        level = level_of[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        order = np.argsort((level & 127).astype(np.int16), kind="stable")  # s is in hash order
                        first = order[: n - least_common(n) + 1]
                        picked.append(s[first])
                        deal.append(level[first] >= 128)
                    tokens.append(np.concatenate(picked))
                    salted.append(np.concatenate(deal))
                    nodes.append(node)
                    sizes.append(n)
                    held += len(tokens[-1])
                if held > BUCKET:
                    yield flush(tokens, nodes, sizes, salted)
                    tokens, nodes, sizes, salted, held = [], [], [], [], 0
        if held:
            yield flush(tokens, nodes, sizes, salted)

    return run


def _shared(buckets: int):
    """Of one bucket the entries whose token two nodes have; dealt-out lists whole."""
    def run(rows: pa.Table) -> pa.Table:
        def parts(column: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(v.as_buffer(), kind) for v in rows[column]]

        token, which = np.concatenate(parts("tokens", np.uint64)), parts("which", np.uint32)
        node, size = (np.concatenate([v[w] for v, w in zip(parts(c, kind), which)]) for c, kind in (("nodes", np.int64), ("sizes", np.int32)))
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        same = token[1:] == token[:-1]
        fresh = np.append(True, ~(same & (node[1:] == node[:-1])))
        token, node, size = token[fresh], node[fresh], size[fresh]
        same = np.concatenate(([False], token[1:] == token[:-1], [False]))
        kept = (same[1:] | same[:-1]) if rows["bucket"][0].as_py() < buckets else np.ones(len(token), bool)
        return pa.table({"token": token[kept].view(np.int64), "node": node[kept], "n": size[kept]})

    return run


# ---------------------------------------------------------------- verification

def _needed(n: str, m: str) -> str:
    """Of sets of sizes n and m, the least intersection of a link."""
    return f"ceil({SHARE} * ({n} + {m}) / {100 + SHARE})"


def _room(common: str) -> str:
    """Whether ``common`` listed shingles in both leave room for a link of sizes nu and nv.

    All shingles up to the end of the shorter prefix that two sets share are in
    both lists; beyond it at most n less the prefix are left. Light sets are
    listed by subsets and always have room.
    """
    rest = f"(greatest(ceil({SHARE} * nu / 100), ceil({SHARE} * nv / 100)) - 1)"
    return (f"100 * least(nu, nv) >= {SHARE} * greatest(nu, nv) AND (greatest(nu, nv) <= {{boundary}} OR "
            f"{common} >= {_needed('nu', 'nv')} - {rest})")


def _plausible(pairs: DataFrame, slim: DataFrame, boundary: int) -> DataFrame:
    """The pairs whose listed shingles leave room for a link: by how many each has, then by how many both have."""
    for end in ("u", "v"):
        pairs = pairs.join(slim.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("m").alias(f"m{end}")), end)
    pairs = pairs.where(_room("least(mu, mv)").format(boundary=boundary))
    for end in ("u", "v"):
        pairs = pairs.join(slim.select(F.col("node").alias(end), F.col("tokens").alias(f"t{end}")), end)
    return pairs.where(_room("size(array_intersect(tu, tv))").format(boundary=boundary)).select("u", "v")


def _filter_of(keys: DataFrame, many: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of two bits a key; its size follows the number of keys up to 2^27 bits."""
    bits = int(min(max(np.ceil(np.log2(16 * many + 1)), 16), 27))
    place = F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64("key", F.lit(i)), 64 - bits) for i in (1, 2)]))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toArrow()
    table = np.zeros(max(1, 2**bits // 64), np.int64)
    table[words["w"].to_numpy()] = words["m"].to_numpy()
    return table, bits


def _sets(wanted):
    """(node, shingles) of the rows whose key may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for name in ("p1", "p2"):
                p = batch.column(name).to_numpy()
                keep &= (table[p >> 6] >> (p & 63) & 1).astype(bool)
            for texts in C.text_chunks(batch.column("text").filter(pa.array(keep))):
                found = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["node", "shingles"])

    return run


def _fetch(documents: DataFrame, info: DataFrame, nodes: DataFrame, space: C.Workspace, name: str) -> DataFrame:
    """(node, shingles) of the given nodes, from one reading of the texts without shuffling them."""
    spark = documents.sparkSession
    keys = info.join(nodes, "node").groupBy("node").agg(F.min("key").alias("key"))
    many = nodes.count()
    table, bits = _filter_of(keys.select("key"), many)
    wanted = spark.sparkContext.broadcast(table)
    places = [F.shiftrightunsigned(F.xxhash64(F.xxhash64("text"), F.lit(i)), 64 - bits).alias(f"p{i}") for i in (1, 2)]
    rows = documents.select("text", *places).mapInArrow(_sets(wanted), "node long, shingles binary")
    sets = space.keep(rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]), name)
    wanted.destroy()
    return sets


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        last, b = None, None
        for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"))):
            y = y.as_buffer()
            if last is None or not y.equals(last):
                last, b = y, np.frombuffer(y, np.uint64)
            a = np.frombuffer(x.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common = int((large[at] == small).sum())
            keep[i] = 100 * common >= SHARE * (len(a) + len(b) - common)
        rows = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"])
        yield rows.filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those that link."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_check, "u long, v long")


#: Whether sizes n and nv allow a link.
_FITS = f"100 * least(n, nv) >= {SHARE} * greatest(n, nv)"


def _pairs(near: DataFrame) -> DataFrame:
    """Each pair (u, v) once, the larger node first."""
    return near.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists with members of several components, each member with its component."""
    member = lists.join(found, "node", "left").select(
        "token", "node", "n", F.coalesce("component", "node").alias("component"))
    several = member.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return member.join(several.select("token"), "token")


def _across(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (u, v) of one list in different components, of sizes that can link."""
    v = others.select("token", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"))
    return rows.join(v, "token").where(f"component <> cv AND {_FITS}").select(F.col("node").alias("u"), "v")


def _counted(sized: DataFrame, boundary: int) -> DataFrame:
    """The plausible pairs of short lists: the lists two members share are counted by the join itself.

    Lists of one component hold no pair across components, so what both share is
    in the short lists, or in the long ones, of which a member's number is known.
    """
    long = sized.where("tiles > 1").groupBy("node").agg(F.count("*").alias("far"))
    short = sized.where("tiles = 1").join(long, "node", "left").withColumn("far", F.coalesce("far", F.lit(0)))
    u, v = (short.select("token", F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("m").alias(f"m{e}"),
                         F.col("component").alias(f"c{e}"), F.col("far").alias(f"f{e}")) for e in "uv")
    met = u.join(v, "token").where("u > v AND cu <> cv").where(_room("least(mu, mv)").format(boundary=boundary))
    counts = met.groupBy("u", "v").agg(F.count("*").alias("both"), *[F.first(c).alias(c) for c in ("nu", "nv", "fu", "fv")])
    return counts.where(_room("both + least(fu, fv)").format(boundary=boundary)).select("u", "v")


def _tiled(rows: DataFrame, slim: DataFrame, boundary: int) -> DataFrame:
    """The plausible pairs of long lists, tile against tile, each pair in the list of its first common token."""
    rows = rows.join(slim.select("node", "tokens"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "token", "node", "n", "component", "tokens", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))

    def compare(rows: pa.Table) -> pa.Table:
        node, n, comp, tile = (rows[c].to_numpy() for c in ("node", "n", "component", "tile"))
        token, lo, hi = (rows[c][0].as_py() for c in ("token", "lo", "hi"))
        counts = pc.list_value_length(rows["tokens"]).to_numpy()
        vocabulary, at = np.unique(pc.list_flatten(rows["tokens"]).to_numpy(), return_inverse=True)
        has = np.zeros((len(rows), len(vocabulary)), np.float32)
        has[np.repeat(np.arange(len(rows)), counts), at] = 1
        here = int(np.searchsorted(vocabulary, token))
        left = np.flatnonzero(tile == lo)
        right = np.flatnonzero(tile == hi)
        a, b = n[left][:, None].astype(np.int64), n[right][None, :].astype(np.int64)
        common = (has[left] @ has[right].T).astype(np.int64)
        large, small = np.maximum(a, b), np.minimum(a, b)
        needed = -(-SHARE * (a + b) // (100 + SHARE)) - (-(-SHARE * large // 100) - 1)
        fine = (comp[left][:, None] != comp[right][None, :]) & (100 * small >= SHARE * large)
        fine &= (large <= boundary) | (common >= needed)
        if lo == hi:
            fine &= node[left][:, None] > node[right][None, :]
        i, j = np.nonzero(fine)
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            both = has[left[i[k: k + 4096]]] * has[right[j[k: k + 4096]]]
            keep[k: k + 4096] = both.argmax(1) == here
        u, v = node[left[i[keep]]], node[right[j[keep]]]
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return rows.groupBy("token", "lo", "hi").applyInArrow(compare, "u long, v long")


def classes(documents: DataFrame, space: C.Workspace) -> DataFrame:
    """(doc_id, key, n_shingles, node, component_id) per row; key is xxhash64 of the text."""
    with C.batches_of(documents.sparkSession, BATCH_ROWS):
        info, final = _resolved(documents, space)
    named = info.join(final, "node", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "node", F.coalesce("component", "node").alias("component"))
    named = named.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "key", F.col("n_shingles").cast("long").alias("n_shingles"), "node",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _resolved(documents: DataFrame, space: C.Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, n, lead) per row, and (node, component) of the nodes with links."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    described = space.keep(rows.mapInArrow(
        _describe, "doc_id long, key long, node long, n int, lead long, block int, counts binary"), "described")
    info = described.where("block IS NULL").drop("block", "counts")
    levels = spark.sparkContext.broadcast(_levels(described))
    boundary = _boundary(info)
    entries = info.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(32, int(entries // BUCKET) + 1)
    packed = documents.select("text").mapInArrow(
        _entries(levels, boundary, buckets), "bucket long, tokens binary, which binary, nodes binary, sizes binary")
    lists = space.keep(packed.groupBy("bucket").applyInArrow(_shared(buckets), "token long, node long, n int"), "lists")
    levels.destroy()

    slim = space.keep(lists.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.max("n").alias("n"), F.count("*").alias("m")), "slim")

    # every member of a list against two pivots of it
    first = lists.groupBy("token").agg(F.min("node").alias("v"), F.max("node").alias("w"))
    near = lists.join(first, "token").select(F.col("node").alias("u"), F.explode(F.array("v", "w")).alias("v"))
    pairs = space.keep(_plausible(_pairs(near), slim, boundary), "pairs-0")
    ends = space.keep(_ends(pairs), "ends-0")
    sets = _fetch(documents, info, ends, space, "sets-0")
    links = space.keep(_linked(pairs, sets), "links-0")
    # of lists with several components, every member against more pivots of other components, at last against all
    for step in range(1, ROUNDS + 2):
        found = space.keep(components(links, space, f"c{step}"), f"found-{step}")
        rest = space.keep(_open(lists, found), f"open-{step}")
        if step <= ROUNDS:
            turn = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(step)), "node")
            pivots = rest.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= PIVOTS)
            more = _plausible(_pairs(_across(rest, pivots)), slim, boundary)
        else:
            sizes = rest.groupBy("token").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
            sized = space.keep(rest.join(sizes, "token").join(slim.select("node", "m"), "node"), "sized")
            more = space.keep(_counted(sized, boundary).unionByName(
                _tiled(sized.where("tiles > 1").drop("m"), slim, boundary)).distinct(), "counted")
        more = space.keep(more.join(pairs, ["u", "v"], "left_anti"), f"more-{step}")
        ends = space.keep(_ends(more), f"ends-{step}")
        missing = space.keep(ends.join(sets.select("node"), "node", "left_anti"), f"missing-{step}")
        sets = sets.unionByName(_fetch(documents, info, missing, space, f"sets-{step}"))
        late = space.keep(_linked(more, sets.join(ends, "node", "left_semi")), f"links-{step}")
        pairs, links = pairs.unionByName(more), links.unionByName(late)
    final = space.keep(components(links, space, "last"), "final")
    space.drop("lists", "slim", "sized", "counted", *(f"{n}-{i}" for n in ("pairs", "more", "ends", "missing", "sets", "links", "found", "open") for i in range(ROUNDS + 2)))
    return info, final


def keep_one(documents: DataFrame, space: C.Workspace) -> DataFrame:
    """One document of each component, that with the least id; rows without a shingle all stay.

    Of rows that agree in id and text one stays. The columns are those of ``documents``.
    """
    named = classes(documents, space)
    kept = named.where("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("s")).select("s.doc_id", "s.key")
    kept = space.keep(kept.unionByName(named.where("n_shingles = 0").select("doc_id", "key").distinct()), "kept")
    keyed = documents.withColumn("__key", F.xxhash64("text"))
    joined = keyed.join(kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__kept")),
                        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept")), "left_semi")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return joined.where(~blank).dropDuplicates(["doc_id", "__key"]).unionByName(joined.where(blank)).select(*documents.columns)
