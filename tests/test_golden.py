"""Known inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, records, scoring, sheets, text
from ledgerloom.operators import distribution, lookups, metrics, quality, signals


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("given,want", [
    ("1,250.50", 1250.5), ("1.250,50", 1250.5), ("€ 1 250,50", 1250.5), ("1250,50", 1250.5), ("1,250", 1250.0),
    ("1,250,000", 1250000.0), ("-12.5 EUR", -12.5), ("", None), ("n/a", None), ("12,5", 12.5), ("1.2.3", None),
])
def test_parse_amount(spark, given, want):
    assert one(spark, given, amounts.parse_amount) == want


@pytest.mark.parametrize("given,want", [
    ("Total: $1,500.00", "USD"), ("1.250,50 EUR", "EUR"), ("France 12", "EUR"), ("Fr 12", "CHF"), ("", "UNKNOWN"),
    ("12 gbp", "GBP")])
def test_currency(spark, given, want):
    assert one(spark, given, amounts.detect_currency) == want


def test_amounts_in_text(spark):
    given = "Total HT: 1,000.00 EUR, TVA 20%, Total TTC: 1,200.00 EUR"
    a = one(spark, given, amounts.extract_amounts)
    assert (a.amount_ht, a.amount_ttc, a.tax_rate, a.tax_amount, a.currency) == (1000.0, 1200.0, 0.2, 20.0, "EUR")
    assert one(spark, "VAT 5.5%", amounts.parse_tax_rate) == 0.055
    assert one(spark, "1250.5", lambda c: amounts.format_amount(c.cast("double"), F.lit("EUR"))) == "1 250,50 EUR"


@pytest.mark.parametrize("given,european,want", [
    ("15/03/2024", True, dt.date(2024, 3, 15)), ("03/15/2024", False, dt.date(2024, 3, 15)),
    ("03/15/2024", True, dt.date(2024, 3, 15)), ("2024-03-15", True, dt.date(2024, 3, 15)),
    ("2024/03/15", True, dt.date(2024, 3, 15)), ("15.03.2024", True, dt.date(2024, 3, 15)),
    ("15-03-24", True, dt.date(2024, 3, 15)), ("15.03.99", True, dt.date(1999, 3, 15)), ("15/03/24", True, None),
    ("March 15, 2024", True, dt.date(2024, 3, 15)), ("15 Mar 2024", True, dt.date(2024, 3, 15)),
    ("15 mars 2024", True, dt.date(2024, 3, 15)), ("le 1 août 2024", True, dt.date(2024, 8, 1)),
    ("31/02/2024", True, None), ("32/13/2024", True, None), ("soon", True, None), ("", True, None)])
def test_parse_date(spark, given, european, want):
    assert one(spark, given, lambda c: dates.parse_date(c, european)) == want


@pytest.mark.parametrize("given,want", [
    ("Q1 2024", dt.date(2024, 3, 31)), ("H2 2024", dt.date(2024, 12, 31)), ("30 days net", dt.date(2001, 9, 14)),
    ("end of month", dt.date(2001, 8, 31)), ("fin d'année", dt.date(2001, 12, 31)), ("later", None)])
def test_relative_date(spark, given, want):
    assert one(spark, given, lambda c: dates.relative_date(c, dt.date(2001, 8, 15))) == want


def test_date_helpers(spark):
    row = spark.sql("SELECT DATE '2024-01-01' i, DATE '2024-02-15' p, DATE '2024-03-15' f").select(
        dates.payment_delay(F.col("i"), F.col("p")).alias("late"), dates.fiscal_year("f", 4).alias("fy"),
        dates.format_date("f", "french").alias("fr")).first()
    assert (row.late, row.fy, row.fr) == (15, 2023, "15 mars 2024")
    found = one(spark, "Paid 15/03/2024, due 15 avril 2024 (2024-1)", dates.extract_dates)
    assert found == [dt.date(2024, 3, 15), dt.date(2024, 4, 15)]


def test_decision_score_keeps_factor_order(spark):
    row = spark.range(1).select(scoring.decision_score(F.lit("critical"), F.lit(0.85), F.lit(1.9)).alias("s")).first()
    assert row.s == 48.4


def test_party_and_parties(spark):
    assert one(spark, "ACME", records.party).name == "ACME"
    assert one(spark, '{"company_name": "ACME", "tva": "FR1"}', records.party).vat_number == "FR1"
    people = spark.range(1).select(records.parties(F.array(F.lit("A"), F.lit('{"name":"B","role":"vendor"}'))).alias("p"))
    assert people.select(records.provider(F.col("p"), F.lit("C")).alias("v")).first().v == "B"


def test_sheet_columns():
    assert sheets.column_mapping(["Département", "Catégorie", "Budget Annuel", "Q1", "Réel"]) == {
        "Département": "department", "Catégorie": "category", "Budget Annuel": "budget", "Q1": "q1", "Réel": "actual"}


def test_status_and_type(spark):
    assert one(spark, "This is unpaid", text.invoice_status) == "UNPAID"
    assert one(spark, "Facture réglée", text.invoice_status) == "PAID"
    assert one(spark, "software consulting", text.contract_type) == "LICENSE"


def test_contract_values(spark):
    f = one(spark, "between Acme Inc and Bob, for $2.5 million. Effective date: March 1, 2024. Terminates on May 2, 2025",
            text.contract_fields)
    assert (f.annual_value, f.start_date, f.end_date) == (2500000.0, dt.date(2024, 3, 1), dt.date(2025, 5, 2))
    assert f.vendor == "Acme Inc"


def test_expiry_today_is_due_today(spark):
    c = spark.sql("SELECT 'C' contract_id, 'V' vendor, 1 annual_value, DATE '2024-01-01' end_date")
    assert lookups.contracts_raw(c, dt.date(2024, 1, 1)).first().days_until_expiry == 0


def test_anomalies_need_more_than_three(spark):
    few = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate([100, 150, 10000])], "invoice_id string, amount double")
    assert metrics.amount_anomalies(few).count() == 0
    many = spark.createDataFrame([(str(i), 100.0) for i in range(30)] + [("x", 9000.0)], "invoice_id string, amount double")
    assert [r.invoice_id for r in metrics.amount_anomalies(many).collect()] == ["x"]


def test_cluster_id_ignores_order_but_not_multiplicity(spark):
    def cluster(rows):
        df = spark.createDataFrame(rows, "type string, subject string, detail string, weight bigint")
        return signals.cluster(df, dt.date(2024, 1, 1)).first().id

    a, b = ("budget_slightly_over", "IT", "", 2), ("invoice_moderately_overdue", "V", "", 2)
    assert cluster([a, b]) == cluster([b, a]) != cluster([a, b, b])
    low = spark.createDataFrame([a], "type string, subject string, detail string, weight bigint")
    assert signals.cluster(low, dt.date(2024, 1, 1)).count() == 0


def test_list_id_is_md5_of_the_sorted_json_list(spark):
    import hashlib
    import json

    names = ["b:y", "a:x"]
    want = "ws_" + hashlib.md5(json.dumps(sorted(names)).encode()).hexdigest()
    assert spark.range(1).select(signals.list_id(F.array(*[F.lit(n) for n in names])).alias("i")).first().i == want


def test_negative_total_is_invalid(spark):
    inv = spark.sql("SELECT 'INV-001' invoice_id, CAST(NULL AS STRING) vendor, 'c' client, DATE '2024-01-01' date, "
                    "DATE '2024-01-02' due_date, 1.0D total_ht, 0.2D tax_rate, -100.0D total_ttc, "
                    "CAST(NULL AS ARRAY<STRUCT<description:STRING,quantity:DOUBLE,unit_price:DOUBLE>>) items")
    row = quality.validate_invoices(inv).first()
    assert not row.is_valid
    assert {e.code for e in row.errors} == {"missing_vendor", "vendor_name_missing", "negative_ttc"}


def test_an_outcome_recorded_once_stays(spark):
    from ledgerloom.operators import feedback

    stored = spark.createDataFrame([("a", "x", "e", "m", 10.0, 12.0), ("b", "x", "f", "m", 10.0, None), ("c", "x", "g", "m", 10.0, 5.0)],
                                   "id string, entity_type string, entity_id string, metric string, predicted_value double, actual_value double")
    new = spark.createDataFrame([("b", 10.5, 1), ("c", 9.0, 1)], "prediction_id string, actual_value double, seq int")
    got = {r.id: r.actual_value for r in feedback.resolve(stored, new).collect()}
    assert got == {"a": 12.0, "b": 10.5, "c": 9.0}


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    from ledgerloom.sources import files

    (tmp_path / "a.csv").write_text("date,account,account_name,description,debit,credit,reference\n2024-03-15,601,n,d,5,,r1\n")
    (tmp_path / "b.csv").write_text("account,credit,date,debit\n707,7.5,2024-03-16,\n")
    (tmp_path / "c.csv").write_text("no,header,here\n1,2,3\n")
    got = sorted((r.account, str(r.date), r.debit, r.credit, r.reference) for r in files.read_ledger(spark, str(tmp_path)).collect())
    assert got == [("601", "2024-03-15", 5.0, None, "r1"), ("707", "2024-03-16", None, 7.5, None)]


def test_nothing_is_cut(spark):
    from ledgerloom.functions import sheets, text
    from ledgerloom.sources import files

    long = "V" * 200
    table = spark.createDataFrame([(long,)], "Vendor string")
    assert files.contracts_from_flat(table).first().vendor == long
    body = "\n".join(["ab"] * 20 + ["Real Vendor SA", "Client"] + ["x:"] * 15 + ["Far Client GmbH", "Payment terms: " + "t" * 300])
    row = spark.createDataFrame([(body,)], "t string").select(text.invoice_fields("t").alias("f")).first().f
    assert row.vendor == "Real Vendor SA" and row.client == "Far Client GmbH" and row.payment_terms == "t" * 300
    grid = spark.createDataFrame([(1, "title\n" * 25 + "Compte;Montant total;Période")], "i int, t string")
    assert sheets.header_row(grid, "i", "t").first().header_row == 25


def test_contract_dates_in_order_of_priority(spark):
    from ledgerloom.functions import text

    body = ("Commencement date: March 5, 2024 and effective as of March 1, 2024, payable until June 1, 2024, "
            "initial term ending December 31, 2025")
    row = spark.createDataFrame([(body,)], "t string").select(text.contract_fields("t").alias("f")).first().f
    assert (str(row.start_date), str(row.end_date)) == ("2024-03-01", "2025-12-31")


def test_quantiles_of_small_numbers_order_few_rows(spark):
    values = [i / 1e7 for i in range(-2000, 8000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    _, _, held = distribution.brackets(rows, "x", [0.05, 0.5], 99)
    assert all(n < 100 for _, n in held.values())
    got = distribution.percentiles(rows, "x", [0.05, 0.5], 99).first()
    assert abs(got["p5"] - (values[499] + (values[500] - values[499]) * 0.95)) < 1e-12
    assert abs(got["p50"] - (values[4999] + values[5000]) / 2) < 1e-12


def test_csv_files_lose_no_rows_for_their_header(spark, tmp_path):
    """Other known names, other case, missing columns and a data line like a header; a file without known columns is reported."""
    from ledgerloom.sources import files

    for name, text in {"a": "Party Name,Contract Value\nAcme,EUR 10\n", "b": "COMPANY,annual value\n\"Beta, Ltd\",20\nCompany,Annual Value\n",
                       "c": "x,y\n1,2\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    table = files.read_named_csv(spark, str(tmp_path), files.FLAT_NAMES, files.FLAT_NAMES)
    got = {(r.vendor, r.annual_value) for r in files.contracts_from_flat(table).collect()}
    assert got == {("Acme", 10.0), ("Beta, Ltd", 20.0), ("Company", 0.0)}
    bad = files.bad_csv_files(spark, str(tmp_path), files.FLAT_NAMES).collect()
    assert [(r.source_file[-5:], r.header) for r in bad] == [("c.csv", "x,y")]


def test_ledger_with_missing_columns_keeps_its_rows(spark, tmp_path):
    from ledgerloom.sources import files

    (tmp_path / "l.csv").write_text("Date,Debit\n2024-01-02,5\n")
    (tmp_path / "m.csv").write_text("Account,Credit\n601,7\n")
    got = {(str(r.date), r.account, r.debit and float(r.debit), r.credit and float(r.credit)) for r in files.read_ledger(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-02", None, 5.0, None), ("None", "601", None, 7.0)}


def test_invoice_ids_in_order_of_priority_and_near_the_word(spark):
    cases = {"Invoice number: A-17 then invoice # B-18": "B-18", "invoice number: C19": "C19", "N° facture : D-20": "D-20",
             "Facture N° 2024-0001": "2024-0001", "ref INV-2024-0007": "2024-0007",
             "your Invoice with the reference XY-4711 of May": "XY-4711", "invoice one two three four XY-4711": None,
             "Invoice see TOTAL": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.invoice_fields("t").alias("f")).collect()
    assert {r.t: r.f.invoice_id for r in rows} == cases


def test_contract_vendor_in_order_of_priority(spark):
    cases = {"Supplier: Late Corp\nagreement between Acme Inc and Bob": "Acme Inc", "Vendor - Beta Ltd; x": "Beta Ltd",
             "Supplier: Late Corp\nParty: one, First SA\n": "First SA", "a firm known as Gamma LLC\n": "Gamma LLC",
             "entered into by Delta Corp and others": "Delta Corp", "nobody": "Unknown Vendor"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.contract_fields("t").alias("f")).collect()
    assert {r.t: r.f.vendor for r in rows} == cases
