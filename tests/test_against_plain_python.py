"""Operators without a SQL twin, and scale paths, against plain loops on small data."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import distribution, duplicates, numbering, vectors
from ledgerloom.sources import deltas, sinks


def similarity(a, b):
    scores = []
    if a[1] is not None and b[1] is not None:
        scores.append(SequenceMatcher(None, a[1].lower(), b[1].lower()).ratio())
    if a[2] is not None and b[2] is not None:
        x, y = a[2], b[2]
        r = min(abs(x), abs(y)) / max(abs(x), abs(y)) if x and y and x * y > 0 else 0.0
        scores.append(1.0 if x == y else (r if r > 0.99 else 0.0))
    if a[3] is not None and b[3] is not None:
        scores.append(1.0 if a[3] == b[3] else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


@pytest.mark.parametrize("tile", [2000, 5])
def test_fuzzy_duplicates_find_all_pairs(spark, tile):
    rng = random.Random(7)
    names = ["Acme Corp", "Acme Corp.", "Acne Corp", "Beta Limited", "beta limited", "Gamma Supplies", None]
    docs, seen = [], set()
    while len(docs) < 160:
        vendor = rng.choice(names)
        amount = rng.choice([None, 100.0, 100.5, 101.2, 99.1, -100.0, 0.0, 250.0, 252.0])
        day = rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
        key = (vendor.lower() if vendor else None, amount, day)
        if key in seen and rng.random() < 0.7 or (amount is None or day is None) and rng.random() < 0.6:
            continue
        if amount is None and day is None or vendor is None and (amount is None or day is None):
            continue
        seen.add(key)
        docs.append((len(docs), vendor, amount, day))
    df = spark.createDataFrame(docs, "id long, vendor string, amount double, date date")
    got = {(r.id_a, r.id_b): r.similarity for r in duplicates.fuzzy_duplicates(df, tile=tile).collect()}

    def key(d):
        return (d[1].lower() if d[1] else None, d[2], d[3])

    first = {}
    for d in docs:
        first.setdefault(key(d), d[0])
    reps = [d for d in docs if first[key(d)] == d[0]]
    want = {(first[key(d)], d[0]): 1.0 for d in docs if first[key(d)] != d[0]}
    for i, a in enumerate(reps):
        for b in reps[i + 1:]:
            crossed = (a[2] is None and b[3] is None) or (a[3] is None and b[2] is None)
            s = similarity(a, b)
            if s >= 0.95 and not crossed:
                want[(a[0], b[0])] = s
    wrong = [(docs[a], docs[b], got.get((a, b)), want.get((a, b))) for a, b in set(got) ^ set(want)]
    assert not wrong, wrong[:5]
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("threshold,tile", [(0.95, 2000), (0.7, 3)])
def test_fuzzy_duplicates_without_a_common_number(spark, threshold, tile):
    """Numberless and crossed pairs too, and a lower threshold: as all pairs say."""
    names = ["Acme Corporation", "Acme Corporatio", "Acne Corp", "Beta Limited", "Zeta Limit", None]
    days, sums = [None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)], [None, 100.0, 100.4, 250.0]
    docs = [(i, *d) for i, d in enumerate((n, a, d) for n in names for a in sums for d in days)]
    df = spark.createDataFrame(docs, "id long, vendor string, amount double, date date")
    rows = duplicates.fuzzy_duplicates(df, threshold, tile).collect()
    got = {(r.id_a, r.id_b): r.similarity for r in rows}
    scores = {(a[0], b[0]): similarity(a, b) for i, a in enumerate(docs) for b in docs[i + 1:]}
    want = {k: v for k, v in scores.items() if v >= threshold}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


PLAIN = [
    (r"\b\d{14}\b", 0), (r"\b[A-Z]{2}\d{11}\b", 0),
    (r"\b([A-ZÉÈÊË][A-Za-zéèêëàâùûôîïç\s&-]+)\s+(SA|SARL|SAS|SASU|EURL|SCI)\b", re.IGNORECASE),
    (r"\b([A-Z][A-Za-z\s&-]+)\s+(Ltd|LLC|Inc|Corp|GmbH|AG)\b", re.IGNORECASE),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
    (r"\b(?:0|\+33\s?)[1-9](?:[\s.-]?\d{2}){4}\b", 0),
]


def test_entities_and_places(spark):
    rng = random.Random(3)
    bits = ["Acme & Fils SARL", "à la Maison Dupont SA", "3abc def SAS", "Gamma Ltd", "x12345678901234 ", "12345678901234",
            "FR12345678901", "a.b+c@d-e.fr", "01 23 45 67 89", "+33 612345678", "sa", "éa SCI", "No form here",
            "e-SAS b-AG", "...", "-", "\n", "ç Zeta Inc", "A SA", "  B  Corp  C Inc", "ünder SA"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ". ", ", ", "\n", "; ", "-"]) for _ in range(rng.randint(1, 12)))
             for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", "t", text.entities("t").alias("e")).collect():
        want = [(m.group(), m.start(), m.end()) for p, f in PLAIN for m in re.finditer(p, row.t, f)]
        assert [(e.text, e.start, e.end) for e in row.e] == want, repr(row.t)


def test_asked_types_are_those_of_the_whole_list(spark):
    body = "Acme Gamma Ltd, 12345678901234, compta@exemple.fr, 01 23 45 67 89, FR12345678901 Inc and Beta SARL"
    rows = spark.createDataFrame([(body,), ("",), (None,)], "t string").coalesce(1)
    for kinds in (["SIRET", "EMAIL"], ["ORGANIZATION"], ["PHONE", "VAT_NUMBER"], []):
        got = rows.select(text.entities("t").alias("every"), text.entities("t", kinds).alias("some")).collect()
        for r in got:
            assert r.some == (None if r.every is None else [e for e in r.every if e.type in kinds])


def test_entity_texts_and_parts_of_texts_lose_no_match(spark):
    """Texts and places against each pattern over the whole text, with marks, combining letters and odd cases of letters."""
    rng = random.Random(5)
    bits = ["Acme Sarl", "Gamma İnc", "Beta ınc", "Zeta \u017fas", "Acme SA\u0301", "SA", "LTD", "\u2003AG", "a@b.fr", "a@b.fr\u0301", "x@y", "@",
            "a@b.c|d", "é@b.frx", "\ue000", "\ue001", "01 23 45 67 89", "+33\u00a0612345678", "12345678901234", "\u0661" * 14, "FR12345678901",
            "\U0001d400", "Ünder GmbH", "\n", "a.b@c.de@f.gh", "Corp\U0001f600", "7"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", ",", "\n", "-"]) for _ in range(rng.randint(0, 10))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    plain = F.translate("t", "\ue000\ue001", "  ")
    patterns = [(p, kind, 0) for p, kind, *_ in text.PLAIN_PATTERNS] + [(p, "ORGANIZATION", 2) for p in text.COMPANY_PATTERNS] + [
        (p, kind, 0) for p, kind, *_ in text.CONTACT_PATTERNS]
    rows = df.select("t", text.entities("t").alias("e"), text.entity_texts("t").alias("x"), text.entity_texts("t", ["EMAIL"]).alias("mail"), F.array(
        *[F.regexp_extract_all(plain, F.lit(p), F.lit(group)) for p, _, group in patterns]).alias("want")).collect()
    assert sum(len(r.e) for r in rows if r.t is not None) > 300
    for r in rows:
        if r.t is None:
            assert r.e is None and r.x is None
            continue
        want = [(kind, m) for (_, kind, _), found in zip(patterns, r.want) for m in found]
        assert [(e.type, e.text) for e in r.e] == [tuple(x) for x in r.x] == want, repr(r.t)
        assert [tuple(x) for x in r.mail] == [w for w in want if w[0] == "EMAIL"]
        shown = r.t.translate({0xe000: " ", 0xe001: " "})
        assert all(shown[e.start: e.end] == e.text for e in r.e)


def test_no_overlaps_left(spark):
    df = spark.createDataFrame([("Acme Gamma Ltd SA and 12345678901234 Inc",)], "t string")
    kept = df.select(text.without_overlaps(text.entities("t")).alias("e")).first().e
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:]))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [0.0] * 50 + [1.0], [x * x - 300.0 for x in range(60)]])
def test_percentiles_match_numpy(spark, values):
    shares = [0.01, 0.05, 0.5, 0.95, 0.99]
    got = distribution.percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", shares).first()
    assert np.allclose(list(got), np.percentile(values, [100 * s for s in shares]))


def test_tail_risk_matches_numpy(spark):
    values = np.random.default_rng(1).normal(100, 40, 500).round(2)
    got = distribution.tail_risk(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()
    var = np.percentile(values, 5)
    assert np.allclose([got["var"], got["cvar"]], [var, values[values <= var].mean()])


def test_both_ways_of_searching_agree(spark):
    rng = np.random.default_rng(2)
    stored = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)]
    asked = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)]
    v = spark.createDataFrame(stored, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    inline = {(r.query_id, r.rank): r.vec_id for r in vectors.cosine_topk(v, q, 5).collect()}
    tiled = {(r.query_id, r.rank): r.vec_id for r in vectors.cosine_topk(v, q, 5, inline_queries=4).collect()}
    want = {}
    for i, a in asked:
        sims = sorted(stored, key=lambda s: (-np.dot(a, s[1]) / np.linalg.norm(s[1]), s[0]))
        want.update({(i, k + 1): s[0] for k, s in enumerate(sims[:5])})
    assert inline == tiled == want


def test_numbers_have_no_gaps(spark):
    ids = [i * i for i in range(200)] + [10 ** 15]
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(7)
    got = {r.k: r.n for r in numbering.number_rows(df, "k", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(ids))}


def test_numbers_go_by_ranges_of_about_equal_size(spark):
    n = 50_000
    df = spark.range(n).select(F.pow(F.lit(1.0005), F.col("id")).alias("k"), "id")
    numbered = numbering.number_rows(df.repartition(5, "id"), "k", "n")
    assert numbered.where("n <> id + 1").count() == 0
    ranged = df.repartitionByRange("k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n / 8 * 1.5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert numbering.number_rows(df.limit(0), "k", "n").count() == 0


def quantile_columns():
    rng = np.random.default_rng(4)
    return {"times": 1_700_000_000 + rng.permutation(1_000_000).astype(float), "one value": np.full(1_000_000, 7.5),
            "half one value": np.where(np.arange(400_000) % 2, 3.0, rng.lognormal(0, 9, 400_000)),
            "ends": np.array([-np.inf] * 40 + [np.inf] * 60 + list(range(100)), float)}


@pytest.mark.parametrize("name", list(quantile_columns()))
def test_quantiles_order_only_a_few_rows(spark, name, tmp_path):
    import pandas as pd

    values, most = quantile_columns()[name], 20_000 if name != "ends" else 10
    pd.DataFrame({"x": values}).to_parquet(tmp_path / "x.parquet", row_group_size=50_000)
    rows = spark.read.parquet(str(tmp_path / "x.parquet"))
    shares = [0.01, 0.25, 0.5, 0.99]
    total, _, held = distribution.brackets(rows, "x", shares, most)
    assert total == len(values) and all(n <= most for i, (_, n) in held.items() if i % 2 == 0)
    got = distribution.percentiles(rows, "x", shares, most).first()
    if name == "ends":  # what lies at an infinite end has no distance to interpolate
        got, shares = [got["p25"], got["p50"]], [0.25, 0.5]
        values = np.sort(values)
    assert np.allclose(list(got), np.percentile(values, [100 * s for s in shares]), rtol=1e-12)


def test_quantiles_without_values_are_null(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert list(distribution.percentiles(rows, "x", [0.5, 0.9]).first()) == [None, None]


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    schema = "id long, v string, version long, part string"
    table = deltas.DeltaTable(spark, str(tmp_path / "t"), schema, ["id"], ["version"], buckets=4)
    table.upsert(spark.createDataFrame([(i, "a", 1, f"p{i % 3}") for i in range(9)], schema), "stored")
    change = spark.createDataFrame([(1, "b", 2, "p1"), (1, "old", 0, "p1"), (20, "n", 1, "p2")], schema)
    for turn in range(2):
        table.upsert(change, f"change {turn}")
    rows = {r.id: r.v for r in table.read().collect()}
    assert rows == {**{i: "a" for i in range(9)}, 1: "b", 20: "n"}


def test_late_version_does_not_win(spark):
    stored = spark.createDataFrame([(1, "new", 5)], "id long, v string, version long")
    late = spark.createDataFrame([(1, "old", 4)], "id long, v string, version long")
    assert sinks.merge_latest(stored, late, ["id"], ["version"]).first().v == "new"


@pytest.mark.parametrize("n", [1, 10000])
def test_a_contract_has_a_row_for_each_invoice(spark, n):
    from ledgerloom.operators import links

    contracts = spark.createDataFrame([("C1", "v", 5.0), ("C2", "w", 6.0)], "contract_id string, vendor string, annual_value double")
    inv = spark.range(n).selectExpr("concat('I', id) AS invoice_id", "double(id) AS amount", "'PAID' AS status", "DATE '2023-12-30' AS due_date")
    edges = inv.selectExpr("'C1' AS contract_id", "invoice_id").unionByName(spark.createDataFrame([("C1", "gone")], "contract_id string, invoice_id string"))
    rows = links.contract_with_invoices(contracts, edges, inv, dt.date(2024, 1, 1)).collect()
    assert sorted(r.invoice_id for r in rows if r.contract_id == "C1") == sorted(f"I{i}" for i in range(n))
    assert {r.days_overdue for r in rows if r.contract_id == "C1"} == {2}
    assert [tuple(r) for r in rows if r.contract_id == "C2"] == [("C2", "w", 6.0, None, None, None, None)]


@pytest.mark.parametrize("n", [1, 120])
def test_a_contract_has_its_invoices_in_lists(spark, n):
    from ledgerloom.operators import links

    contracts = spark.createDataFrame([("C1", "v", 5.0), ("C2", "w", 6.0)], "contract_id string, vendor string, annual_value double")
    inv = spark.range(n).selectExpr("concat('I', id) AS invoice_id", "double(id) AS amount", "'PAID' AS status", "DATE '2023-12-30' AS due_date")
    edges = inv.selectExpr("'C1' AS contract_id", "invoice_id")
    flat = links.contract_with_invoices(contracts, edges, inv, dt.date(2024, 1, 1))
    rows = links.invoices_in_pages(flat, edges, page_size=50).collect()
    mine = [r for r in rows if r.contract_id == "C1"]
    assert sorted(r.page for r in mine) == list(range(-(-n // 50)))
    assert sorted(i.invoice_id for r in mine for i in r["items"]) == sorted(f"I{i}" for i in range(n))
    assert all(r.invoices == len(r["items"]) and r.amount == sum(i.amount for i in r["items"]) and r["items"] == sorted(r["items"]) for r in mine)
    assert [(r.page, r.invoices, r.amount, r["items"]) for r in rows if r.contract_id == "C2"] == [(0, 0, 0.0, [])]


def test_contracts_show_number_sum_and_ids_of_their_invoices(spark):
    from ledgerloom.plans import all_queries

    rows = all_queries()["contract_with_invoices"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.invoices == len(r.ids.split(",")) == len(r.details.split(",")) for r in rows if r.invoices)
    assert sum(r.invoices for r in rows) > 0 and sum(r.amount for r in rows) > 0


def test_a_prediction_is_stored_once(spark):
    from ledgerloom.operators import feedback

    schema = "id string, entity_type string, entity_id string, metric string, predicted_value double, actual_value double"
    new = spark.createDataFrame([("invoice", "c1", "total", 5.0)] * 2 + [("invoice", "c2", "total", 5.0)],
                                "entity_type string, entity_id string, metric string, predicted_value double")
    once = feedback.append_predictions(spark.createDataFrame([("p0", "x", "y", "z", 1.0, 2.0)], schema), new, dt.date(2024, 1, 1))
    assert once.count() == 3
    assert sorted(feedback.append_predictions(once, new, dt.date(2024, 1, 1)).collect()) == sorted(once.collect())

