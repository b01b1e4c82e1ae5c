"""Cheap looks at a text before its patterns: same finds, narrow rows."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, text
from ledgerloom.plans.entities import Tables
from ledgerloom.plans.texts import invoice_texts
from ledgerloom.sources import files
from tests.conftest import SF

#: The forms of a date one by one.
FORMS = (r"(?U)\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4}"
         r"|(?:(?<!\w)|\G)\w++ \d{1,2}, \d{4}|\d{1,2} \w++ \d{4}")


def test_date_forms_that_share_their_digits_find_the_same(spark):
    random.seed(3)
    parts = ["12", " ", "2024", "-", "/", ".", ", ", "May", "3", "٣", "07"]
    rows = [("".join(random.choice(parts) for _ in range(25)),) for _ in range(5000)]
    df = spark.createDataFrame(rows, "t string")
    a, b, c = (F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (FORMS, dates.DATE_PATTERN, dates.DIGIT_FIRST))
    assert df.where(F.size(a) > 0).count() > 100
    assert df.where(a != b).count() == 0
    assert df.where(~F.col("t").contains(", ")).where(a != c).count() == 0


def test_words_are_found_in_any_case(spark):
    given = "Acme\nFACTURÉ À\n\nTel 1\nBobby\n2 MARS 2024 5 février 0024 x 7, 2024\nTVA: 5,5 EUR (20%)"
    f = spark.createDataFrame([(given,), (given.replace("FACTURÉ À", "cuſtomer clİent"),)], "t string").select(
        text.invoice_fields("t").alias("f")).select("f.*").collect()
    for r in f:
        assert (r.vendor, r.client, str(r.date), str(r.due_date), r.tax_amount, r.tax_rate) == (
            "Acme", "Bobby", "2024-03-02", "0024-02-05", 5.5, 0.2)


def test_a_long_run_of_digits_is_read_once(spark):
    got = spark.createDataFrame([("1" * 200000 + " 12.5 %",)], "t string").select(amounts.parse_tax_rate("t").alias("r")).collect()
    assert got[0].r == 0.125


def test_invoice_rows_move_before_their_texts_are_made(spark):
    plan = invoice_texts(Tables(spark, SF)).select("text")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("RepartitionByExpression")[0]
    assert "Facture" in top and "RepartitionByExpression" in plan


def test_a_record_is_opened_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "debit": "1,250.5", "credit": ""}\n{"id": "2", "debit"\n{"id": "3", "entry_date": "05/06/2024"}\n')
    rows = files.read_entries(spark, str(tmp_path), whole_file=False)
    assert rows.select("entry_id", "debit")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    got = sorted((r.entry_id, str(r.date), r.debit, r.credit) for r in rows.collect())
    assert got == [("1", "None", 1250.5, 0.0), ("3", "2024-06-05", 0.0, 0.0)]
