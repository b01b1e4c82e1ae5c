"""The training-data operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from ledgerloom.llm import chat, common, decontaminate, jaccard, language, lines, mixing, neighbours, quality, scoring, shards
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.tokens import Encoder, read_ranks
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, words string"


def words(n, seed=0):
    random = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in random.integers(0, 4000, n))


def rows():
    base = words(120, 1)
    near = base.replace(base.split()[60], "changed", 1)
    far = " ".join(base.split()[:60]) + " " + words(60, 2)
    out = [(1, base), (2, near), (3, far), (4, base), (4, base), (5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"),
           (10, words(20000, 3)), (None, base), (11, "a b c d e f"), (12, "b c d e f g"), (13, "É é x")]
    out += [(100 + i, words(9, 50) + f" t{i % 3}") for i in range(12)]
    return [(i, t, "en", None if i == 8 else f"s{(i or 0) % 3}", 0, 0.5, "x", "y") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture()
def space(spark):
    return common.Workspace(spark, "test")


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_components(pairs):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(pairs)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_jaccard_is_exact(docs, space):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, space).collect()]
    assert sorted(got, key=key) == sorted(brute_components([(r[0], r[1]) for r in rows()]), key=key)


def test_jaccard_with_many_near_copies(spark, space):
    random = np.random.default_rng(4)
    base = words(60, 9).split()
    table = []
    for i in range(300):
        w = list(base)
        for at in random.integers(0, 60, random.integers(0, 4)):
            w[at] = f"v{random.integers(0, 30)}"
        table.append((i, " ".join(w[: random.integers(4, 61)])))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, space).collect()]
    assert sorted(got) == sorted(brute_components(table))


def test_jaccard_tasks_hold_small_batches(spark, space, tmp_path, monkeypatch):
    describe = jaccard._describe

    def noted(batches):
        def passed():
            for batch in batches:
                with open(tmp_path / "rows", "a") as file:
                    file.write(f"{batch.num_rows}\n")
                yield batch
        yield from describe(passed())

    monkeypatch.setattr(jaccard, "_describe", noted)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    some = [(i, f"some words that all texts begin with and number {i % 1500} at the end") for i in range(4000)]
    assert jaccard.classes(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), space).count() == 4000
    rows = [int(n) for n in (tmp_path / "rows").read_text().split()]
    assert sum(rows) == 4000 and max(rows) <= 1024
    assert spark.conf.get(setting) == before


def test_jaccard_packs_few_signatures_at_once():
    texts = [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    levels = type("Shared", (), {"value": np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)})
    sizes = [sum(len(t.as_py()) // 8 for t in b["tokens"]) for b in jaccard._entries(levels, 0, 32)(iter([batch]))]
    each = 3996 - 2997 + 1
    assert sum(sizes) == 700 * each and max(sizes) <= (1 << 18) + 300 * each


def test_near_duplicates_keep_one(docs, spark):
    kept = jaccard.keep_one(docs, common.Workspace(spark, "keep"))
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[4] and not ids[None] and ids[3] == 1
    assert ids[5] == ids[6] == ids[7] == 1 and ids[8] == 1 and not ids[9]


def test_empty_tables(docs, spark, space):
    none = docs.where("false")
    bench = spark.createDataFrame([(1, words(20, 5))], "item_id long, text string")
    assert jaccard.classes(none, space).count() == 0
    assert decontaminate.contaminated(none, bench, space).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false"), space).count() == 0
    assert mixing.draw(none, F.lit("d"), {}, space).count() == 0
    assert lines.without_boilerplate(none, space).count() == 0
    index, folder = shards.materialise(none, space)
    assert index.count() == 0 and shards.read_back(spark, folder).count() == 0
    assert scoring.scores(none, F.lit(True), space).count() == 0
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}
    model = language.fit(none)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    vectors = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert neighbours.search(vectors, vectors, space).count() == 0


def test_decontamination(spark, space):
    prose = words(30, 7)
    math_item = "If Tom has 12 apples and gives 5 apples to Anna then how many apples does he still have"
    bench = spark.createDataFrame([(1, prose), (2, math_item), (3, "too short"), (4, None)], "item_id long, text string")
    again = math_item.replace("12", "40").replace("Anna", "Beth")
    swapped = "say " + "if Tom has 12 apples and gives 12 apples to Anna then how many apples does he still have"
    table = [(1, words(50, 8) + " " + prose.upper() + ". " + words(20, 9)), (2, "Well, " + again), (3, words(300, 10)), (4, None),
             (5, ""), (None, prose), (6, "x " + prose.split()[0] + " " + " ".join(prose.split()[1:7])), (7, swapped)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, words int")
    found = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, bench, space).collect()}
    assert found == {(1, 1): True, (2, 2): False, (None, 1): True}
    kept = decontaminate.clean(docs, bench, space)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == [3, 4, 5, 6, 7]


def test_clean_documents_are_not_shuffled(spark, space):
    """However many ids are found, within the bound: the texts stay where they are."""
    prose = words(30, 7)
    docs = spark.createDataFrame([(i, f"{words(9, i)} {prose if i % 3 else ''}") for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, prose)], "item_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = decontaminate.clean(docs, bench, space)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 3))
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_decontamination_against_plain_windows(spark, space):
    """Every document of the given table that holds half of an item's plain windows is found, and no other."""
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    import re

    def plain(t):
        return re.findall(r"[^\W\d_]+|\d+", (t or "").lower())

    index = collections.defaultdict(set)
    total = {}
    for r in bench.collect():
        w = plain(r.text)
        total[r.item_id] = len(w) - 7
        for i in range(len(w) - 7):
            index[tuple(w[i:i + 8])].add((r.item_id, i))
    want = set()
    for r in docs.collect():
        w, hit = plain(r.text), collections.defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in index.get(tuple(w[i:i + 8]), ()):
                hit[item].add(at)
        want |= {(r.doc_id, item) for item, at in hit.items() if len(at) >= min(6, math.ceil(total[item] / 2))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, space).collect()} == want and want


def test_mixing_reaches_the_budget(docs, space):
    drawn = mixing.draw(docs, F.lit("d"), {"source": {"s0": 3}}, space, share=(1, 2)).collect()
    tokens = sum(r.n_tokens * r.copies for r in drawn)
    assert tokens > 0 and all(r.copies >= 1 and r.n_tokens > 0 for r in drawn)
    mixed = mixing.mixed(docs, F.lit("d"), {"source": {"s0": 3}}, space, share=(1, 2))
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == tokens


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = shards.slot_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert shards.source_of(slots, n).tolist() == list(range(n))


def test_shards_round_trip(docs, spark, space):
    index, folder = shards.materialise(docs, space, length=64, per_shard=16)
    got = index.join(shards.read_back(spark, folder, 64, 16), "slot").collect()
    assert [r.slot for r in sorted(got)] == list(range(len(got)))
    stream = [None] * len(got)
    for r in got:
        assert r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128
        stream[int(shards.source_of([r.slot], len(got))[0])] = np.frombuffer(r.tokens, np.uint16)[: r.n_tokens]
    coder = Encoder(read_ranks())
    ids = np.concatenate(stream)
    texts = [coder.text(p) for p in np.split(ids, np.flatnonzero(ids == coder.end) + 1)[:-1]]
    assert sorted(texts) == sorted(t[1] for t in rows() if t[1])
    assert all(r.n_tokens == 64 for r in got if shards.source_of([r.slot], len(got))[0] < len(got) - 1)


def test_training_order_starts_no_workers_for_lists(docs, space, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a list travels through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert shards.materialise(docs, space)[0].count() > 0
    assert shards.materialise(docs.limit(0), space)[0].count() == 0


def test_training_order_does_not_depend_on_partitions(docs, spark, space, monkeypatch):
    """Other partitions, another order of the rows and ranges of 500 tokens give the same shards; a task writes one shard."""
    seen = []
    for parts, tokens in ((1, 1 << 21), (7, 500), (3, 40)):
        monkeypatch.setattr(shards, "RANGE_TOKENS", tokens)
        index, folder = shards.materialise(docs.repartition(parts, F.rand(parts)), common.Workspace(spark, f"order{parts}"), length=64, per_shard=16)
        held = index.join(shards.read_back(spark, folder, 64, 16), "slot")
        seen.append(sorted((r.slot, r.shard, r.byte_offset, [str(d) for d in r.doc_ids], r.n_tokens, bytes(r.tokens)) for r in held.collect()))
        per_file = index.groupBy(F.input_file_name()).agg(F.countDistinct("shard").alias("n")).collect()
        assert {r.n for r in per_file} == {1}
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 16


def test_quality_and_language_pass_columns_and_odd_texts(docs, spark):
    clean = [(i, words(40, i), 1) for i in range(60)]
    junk = [(100 + i, " ".join(w + "$$$" for w in words(40, i).split()), 0) for i in range(60)]
    train = spark.createDataFrame(clean + junk, "doc_id long, text string, label int")
    weights = quality.train(train, train.select("doc_id", "label"))
    got = {r.doc_id: r.score for r in quality.score(train, weights).collect()}
    assert min(got[i] for i in range(60)) > max(got[100 + i] for i in range(60))
    scored = quality.score(docs, weights)
    assert set(scored.columns) == set(docs.columns) and scored.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    model = language.fit(common.table(spark, SF, "documents"))
    predicted = language.predict(docs, model)
    und = {r.doc_id for r in predicted.collect() if r.lang_pred == "und"}
    assert {5, 6, 7} <= und and 13 not in und
    assert sum(r.lang == r.lang_pred for r in language.predict(common.table(spark, SF, "documents"), model).collect()) >= 190


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}
    got = QUERIES["op1_language_id"](spark, SF).where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in got]) > 0.9
    labels = {r.doc_id: r.quality for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = [r for r in QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in labels]
    assert np.mean([labels[r.doc_id] == r.predicted for r in got]) > 0.95


def test_lines(docs, spark, space):
    table = [(i, f"own line {i}\nshared by all\n\nshared by two" if i < 2 else f"shared by all\nown {i}", f"site{i}") for i in range(12)]
    table += [(50, None, "a"), (51, "", None), (52, "shared by all", "b"), (52, "shared by all", "b")]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.without_boilerplate(df, space).collect()), key=str)
    assert (0, "own line 0\n\nshared by two", 1) in got and (5, "own 5", 1) in got
    assert (50, None, 0) in got and (51, "", 0) in got and got.count((52, "", 1)) == 2


def test_chat_round_trip(spark):
    nasty = ["\\", "###", "\\### Assistant: </turn> ok", "####\n</turn></turn>\\\\", ":\n", "", "a\nb", "### user:\n"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(["user", "assistant", "odd:\nrole", ""], nasty))]
    turns += [(None, 0, None, None), (2, 0, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1))
    formatted = chat.pieces(chat.canonical_from_rows(df))
    whole = "".join(r.piece for r in formatted.where("conv_id = 1").orderBy("turn").collect())
    assert chat.read_piece(whole) == [(r, t) for c, _, r, t in turns if c == 1]
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    loss = "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].formatted_chars == len(whole) and got[None].n_turns == 1 and got[2].loss_chars == 0


def test_chat_layouts(spark):
    import json

    records = [
        {"id": "a", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"meta": {"id": 7}, "dialog": {"turns": [{"speaker": {"role": "bot"}, "body": {"text": "x"}}]}},
        {"strange": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "record string")
    got = chat.canonical_from_json(df)
    assert chat.unknown_records(got).count() == 3
    assert sorted((r.role, r.text) for r in got.where("turn IS NOT NULL").collect()) == sorted(
        [("user", "hi"), ("assistant", "ho")] * 2 + [("user", "do\nthis"), ("assistant", "done"), ("user", "p"),
                                                     ("assistant", "c"), ("assistant", "x")])


def test_chat_layouts_by_mapped_paths(spark):
    """Further fields and empty turn lists do not hide a layout; a record that is one turn keeps its place."""
    import json

    records = [
        {"id": "a", "messages": [{"role": "user", "content": "hi", "time": 3}, {"role": "gpt", "content": None}], "source": {"x": [1]}},
        {"id": "b", "messages": []}, {"id": "c", "messages": [], "more": 1},
        {"conv_id": 7, "turn": 4, "role": "human", "text": "t", "lang": "en"},
        {"id": "d", "prompt": "p", "completion": "c", "system": "", "score": 0.5},
        {"id": "e", "messages": "no list"}, {"id": "f", "messages": [{"role": "user"}]}, {"id": "g"}, {},
    ]
    got = chat.canonical_from_json(spark.createDataFrame([(json.dumps(r),) for r in records], "record string"))
    assert chat.unknown_records(got).count() == 4
    assert sorted(tuple(r) for r in got.where("turn IS NOT NULL").collect()) == [
        ("7", 4, "user", "t"), ("a", 0, "user", "hi"), ("a", 1, "assistant", ""), ("d", 0, "user", "p"), ("d", 1, "assistant", "c")]


def test_neighbours_recall(spark, space):
    random = np.random.default_rng(1)
    x = (random.normal(size=(10, 16))[random.integers(0, 10, 3000)] + random.normal(size=(3000, 16)) * 0.5).astype(np.float32)
    table = [(i, x[i].tolist()) for i in range(3000)]
    table += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, 2.0]), (None, x[0].tolist()), (3100, x[5].tolist())]
    vectors = neighbours.usable(spark.createDataFrame(table, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), space).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.array([*range(3000), 3100])
    every = np.vstack([x, x[5]]).astype(np.float64)
    found = 0
    for q in [*range(0, 3000, 100), 3100]:
        d = np.sqrt(((every - every[ids == q]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert len(got[q]) == 10 and all(abs(d[list(ids).index(v)] - s) < 1e-9 for v, s in got[q])
        found += len(set(best) & {v for v, _ in got[q]})
    assert found >= 0.9 * 310


def test_scores(docs, spark, space):
    got = scoring.scores(docs, F.col("doc_id") % 2 == 1, space).collect()
    learn = [t for i, t, *_ in rows() if i is not None and i % 2 == 1]
    count = collections.Counter(w for t in learn for w in (t or "").encode().lower().split())
    n, v = sum(count.values()) + len(learn), len(count) + 1
    texts = collections.defaultdict(list)
    for i, t, *_ in rows():
        texts[i].append((t or "").encode().lower().split())
    assert len(got) == len(rows())
    for r in got:
        want = [(len(w) + 1, sum(count[x] > 0 for x in w) + 1,
                 sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [count[x] for x in w] + [len(learn)])) for w in texts[r.doc_id]]
        assert r.train_tokens == n and r.score < 0
        assert any(r.n_tokens == a and r.n_known == b and abs(r.base_score - c) < 1e-6 * abs(c) for a, b, c in want)


def test_windows_score_each_id_once():
    p = scoring._start(np.random.default_rng(0))
    random = np.random.default_rng(2)
    sizes = [1, 5, scoring.WINDOW, scoring.WINDOW + 1, 200]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = random.integers(1, scoring.CLASSES, starts[-1])
    got = scoring.log_probabilities(p, ids, starts, 0)
    stride = scoring.WINDOW - scoring.CONTEXT
    for a, b in zip(starts, starts[1:]):
        text = ids[a:b]
        for t in range(len(text)):
            w = 0 if t < scoring.WINDOW else (t - scoring.CONTEXT) // stride
            seen = np.concatenate(([0], text[:-1]))[w * stride: w * stride + scoring.WINDOW]
            x = np.pad(seen, (0, scoring.WINDOW - len(seen)))[None]
            y = scoring._forward(p, x)["y"][0, t - w * stride]
            z = y @ p["u"] + p["b"]
            assert abs(z[text[t]] - np.log(np.exp(z - z.max()).sum()) - z.max() - got[a + t]) < 1e-3


def small_plan():
    """Classes of a vocabulary of 400 ids and an end, a third of them never seen."""
    counts = np.random.default_rng(4).integers(1, 1000, 401).astype(float)
    counts[1:400:3] = 0
    return scoring._classes(counts)


def test_gradients_are_right():
    random, plan = np.random.default_rng(3), small_plan()
    p = {n: w.astype(np.float64) for n, w in scoring._start(random, len(plan["bias"])).items()}
    p["in"] += random.normal(size=p["in"].shape) / 3
    p["ein"][:-1] += random.normal(size=p["in"].shape) / 3
    seen = np.flatnonzero((np.arange(401) % 3 != 1) | (np.arange(401) == 400))
    line = random.choice(seen, (2, scoring.WINDOW + 1))
    line[0, :2] = np.flatnonzero(plan["slot"] < len(p["in"]))[[0, -1]]
    kind, slot = plan["kind"][line], plan["slot"][line]
    x, y = kind[:, :-1], kind[:, 1:]

    def loss():
        f = scoring._forward(p, x, slot[:, :-1])["y"].reshape(-1, scoring.WIDTH)
        logs = scoring._log_softmax_at(p, f, y.ravel())
        shared = np.flatnonzero(slot[:, 1:].ravel() < len(p["in"]))
        logs[shared] += scoring._log_within(p, f[shared], slot[:, 1:].ravel()[shared], plan)
        return -logs.mean()

    g = scoring._gradients(p, x, y, slot, plan)
    for name in p:
        at = {"emb": (int(x[0, 0]), 3), "in": (int(slot[0, 1]), 2), "ein": (int(slot[0, 0]), 2)}.get(name) or tuple(
            random.integers(0, s) for s in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = loss()
        p[name][at] = old - 1e-5
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5 + 1e-3 * abs(g[name][at]), name


@pytest.mark.parametrize("counts", [None, [5.0, 1.0, 3.0, 2.0], [0.0, 0.0, 0.0, 9.0], [1.0] * 400 + [2.0]])
def test_probabilities_of_all_ids_sum_to_one(counts):
    plan = small_plan() if counts is None else scoring._classes(np.array(counts))
    random = np.random.default_rng(6)
    p = scoring._start(random, len(plan["bias"]))
    p["in"] += random.normal(size=p["in"].shape).astype(np.float32) / 3
    ids = np.arange(len(plan["kind"]))
    # each id is a text of its own, so all are predicted from the same place
    logs = scoring.log_probabilities(p, plan["kind"], np.arange(len(ids) + 1), 0, plan["slot"], plan) + plan["more"]
    used = {c for c in range(scoring.CLASSES) if c not in set(plan["kind"].tolist())}
    y = scoring._forward(p, np.zeros((1, scoring.WINDOW), int), np.full((1, scoring.WINDOW), len(p["in"])))["y"][0, 0]
    z = np.exp((y @ p["u"] + p["b"]).astype(np.float64))
    assert abs(np.exp(logs).sum() + z[sorted(used)].sum() / z.sum() - 1) < 1e-4


def test_training_covers_all_rows_and_grows_with_them(spark, space):
    random, plan = np.random.default_rng(8), small_plan()
    start = scoring._start(random, len(plan["bias"]))
    seen = np.flatnonzero(np.arange(400) % 3 != 1).astype(np.uint16)
    texts = [(random.choice(seen, 3000).tobytes(),) for _ in range(40)]
    shared = spark.sparkContext.broadcast((start, plan))

    def windows(rows):
        df = spark.createDataFrame(rows, "ids binary").repartition(3)
        return sum(r.windows for r in df.mapInArrow(scoring._learn(shared, 1e-3, 0, 400), scoring._NETWORK).collect())

    per_text = 3001 / (scoring.WINDOW * scoring.SPAN * len(scoring.ROUNDS))
    assert abs(windows(texts) - 40 * per_text) <= 3 and abs(windows(texts * 4) - 160 * per_text) <= 3
    nets = [(int(n), scoring._flat(start) * k) for n, k in ((1, 1.0), (3, 5.0))]
    df = spark.createDataFrame([(n, bytearray(w.astype(np.float32).tobytes())) for n, w in nets], scoring._NETWORK).coalesce(1)
    row = df.mapInArrow(scoring._average, scoring._NETWORK).first()
    assert row.windows == 4 and np.allclose(np.frombuffer(row.weights, np.float32), scoring._flat(start) * 4, atol=1e-5)
    got = scoring._trained(spark.createDataFrame([], "ids binary"), start, plan, 400, space)
    assert all((got[n] == start[n]).all() for n in start)


@pytest.mark.parametrize("size", [scoring.WINDOW + 1, scoring.WINDOW + 2, 2 * scoring.WINDOW + 1, 1000, 48001])
def test_every_id_is_learnt_from_over_the_rounds(size):
    places = [scoring._places(size, turn, np.random.default_rng(turn)) for turn in range(len(scoring.ROUNDS))]
    told = np.bincount((np.concatenate(places)[:, None] + np.arange(1, scoring.WINDOW + 1)).ravel(), minlength=size)
    assert told[0] == 0 and (told[1:] > 0).all() and len(told) == size and told.sum() < size + scoring.WINDOW


def test_the_rounds_hold_as_many_windows_as_the_text(spark, space):
    random, plan = np.random.default_rng(8), small_plan()
    seen = np.flatnonzero(np.arange(400) % 3 != 1).astype(np.uint16)
    texts = spark.createDataFrame([(random.choice(seen, n).tobytes(),) for n in (5, 700, 3000, 3000, 9000)], "ids binary").coalesce(1)
    shared = spark.sparkContext.broadcast((scoring._start(random, len(plan["bias"])), plan))
    windows = sum(r.windows for turn in range(len(scoring.ROUNDS))
                  for r in texts.mapInArrow(scoring._learn(shared, 1e-3, turn, 400), scoring._NETWORK).collect())
    assert windows == -(-(5 + 700 + 3000 + 3000 + 9000 + 5) // scoring.WINDOW)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = common.Workspace(spark, "stage").keep(out, name)
        assert docs.count() > 0
    slots = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert slots.count() > 0 and {"slot", "doc_ids"} <= set(slots.columns)


def leaks(spark, space, items, table):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(docs, bench, space).collect()}
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, space).collect()}, kept


PASSAGE = ("a builder fits 3 doors in every house of the long street before the winter comes and the old carpenter then adds "
           "3 windows to each of the houses so that light can reach the rooms where children read their books at night")


def test_an_edited_number_costs_only_its_windows(spark, space):
    """One of two equal numbers edited, two numbers made equal: the untouched windows still count."""
    unequal = PASSAGE.replace("3 windows", "5 windows")
    table = [(1, "well " + PASSAGE.replace("3 windows", "4 windows")), (2, "so " + unequal.replace("5 windows", "3 windows")), (3, words(60, 5))]
    assert leaks(spark, space, [(1, PASSAGE)], table[:1] + table[2:]) == ({(1, 1)}, {3})
    assert leaks(spark, space, [(1, unequal)], table[1:]) == ({(2, 1)}, {3})


def test_names_do_not_depend_on_the_surroundings(spark, space):
    item = ("when the painter Anna met the baker Boris in the town she gave the baker Boris a small basket and the baker Boris "
            "gave the painter Anna a warm loaf")
    quiz = "What is the capital of France today"
    table = [(1, "after 20 minutes London was seen and then " + item), (2, item.lower()), (3, item.upper()),
             (4, "the quiz asks " + quiz), (5, words(60, 6)),
             (6, "after 20 minutes London was seen and then " + item.replace("Anna", "Clara"))]
    found, kept = leaks(spark, space, [(1, item), (2, quiz)], table)
    assert found == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)} and kept == {5}


def test_no_item_is_left_out(spark, space):
    sums, chinese = "12 + 5 = 17; 30 - 4 = 26; 8 + 9 = 17", "中国的首都是哪个城市，它有多少人口？"
    items = [(1, "Capital: Paris"), (2, sums), (None, "an item without an id that is nine words long"), (3, chinese), (4, None), (5, "?!")]
    table = [(1, "we said capital, paris once"), (2, "now " + sums + " end"), (3, "see an item without an id that is nine words long"),
             (4, "问题：" + chinese + "请回答"), (5, "paris capital 12 + 5 = 18; 30 - 4 = 26; 8 + 9 = 17"), (6, "中国的城市很多")]
    found, kept = leaks(spark, space, items, table)
    assert found == {(1, 1), (2, 2), (3, None), (4, 3)} and kept == {5, 6}
