"""Readers for the files a finance team hands over. Every schema is explicit."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import records
from ledgerloom.functions.amounts import parse_amount
from ledgerloom.functions.bind import let
from ledgerloom.functions.dates import norm_date, parse_date

CORRUPT = "_corrupt_record"


def _json(spark: SparkSession, path: str, schema: str, whole_file: bool, good: bool = False) -> DataFrame:
    """Rows of the schema with ``source_file``; an unreadable record keeps its text in ``_corrupt_record``, or is left out
    with ``good``.

    Records are read as text and opened by ``from_json``: rows of Spark's JSON
    reader could not be split into good and bad without being stored first. Good ones are taken from a list of one, since
    a condition on what is opened would move below the opening and open every record twice.
    """
    text = spark.read.option("wholetext", whole_file).option("recursiveFileLookup", True).text(path)
    opened = F.from_json("value", f"{schema}, {CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows, source = text.where(F.trim("value") != ""), F.col("_metadata.file_path").alias("source_file")
    if good:
        return rows.select(F.inline(F.filter(F.array(opened), lambda r: r[CORRUPT].isNull())), source)
    return rows.select(opened.alias("r"), source).select("r.*", "source_file")


def raw_invoices(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """One document per file, or one per line with ``whole_file=False``."""
    return _json(spark, path, records.INVOICE_SCHEMA, whole_file)


def read_invoices(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    return records.normalise_invoices(_json(spark, path, records.INVOICE_SCHEMA, whole_file, good=True))


def read_contracts(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    return records.normalise_contracts(_json(spark, path, records.CONTRACT_SCHEMA, whole_file, good=True))


def read_entries(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    return records.normalise_entries(_json(spark, path, records.ENTRY_SCHEMA, whole_file, good=True))


LEDGER_COLUMNS = ["date", "account", "account_name", "description", "debit", "credit", "reference"]


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _head): the first line of every file that is not blank."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"),
        F.col("_metadata.file_block_start").alias("_block"))
    # places grow along a block of a file
    first = F.min_by("value", F.struct("_block", "_at"))
    return lines.where(F.trim(F.regexp_replace("value", "[\ufeff\r]", "")) != "").groupBy("_file").agg(first.alias("_head"))


def _header_names(head: str) -> list[str]:
    return [c.strip().lower() for c in next(csv.reader([head.replace("\ufeff", "").replace("\r", "")]))]


def _usable(head: str, required: list[str]) -> bool:
    return any(c.lower() in _header_names(head) for c in required)


def read_named_csv(spark: SparkSession, path: str, columns: list[str], required: list[str], folders: str = "",
                   multi_line: bool = False) -> DataFrame:
    """CSV files with a header each, columns bound by name, whatever the order or case in each file.

    A file's first line is its header; columns it lacks are null. Files with none of
    the ``required`` names are returned by :func:`bad_csv_files`. The distinct headers,
    a handful, come to the driver; each is read once. ``folders`` declares partition columns.
    """
    heads = _headers(spark, path)
    extra = [part.split()[0] for part in folders.split(",") if part]
    out = None
    for (head,) in sorted(heads.select("_head").distinct().collect()):
        if not _usable(head, required):
            continue
        names = _header_names(head)
        schema = ", ".join([f"`{i}` string" for i in range(len(names))] + ([folders] if folders else []))
        raw = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option(
            "recursiveFileLookup", not folders).csv(path)
        picked = [(F.col(f"`{names.index(c.lower())}`") if c.lower() in names else F.lit(None).cast("string")).alias(c) for c in columns]
        rows = raw.select(*picked, *extra, F.col("_metadata.file_path").alias("_file"))
        rows = rows.join(heads.where(F.col("_head") == head).select("_file"), "_file", "left_semi").drop("_file")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        parts = [f"`{c}` string" for c in columns] + ([folders] if folders else [])
        return spark.createDataFrame([], ", ".join(parts))
    return out


def bad_csv_files(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(source_file, header, reason) of the files that :func:`read_named_csv` finds no usable column in."""
    heads = _headers(spark, path)
    bad = [head for (head,) in heads.select("_head").distinct().collect() if not _usable(head, required)]
    return heads.where(F.col("_head").isin(bad)).select(
        F.col("_file").alias("source_file"), F.col("_head").alias("header"), F.lit("no known column").alias("reason"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV: dates and amounts read, empty texts as nulls; columns go by their names."""
    raw = read_named_csv(spark, path, LEDGER_COLUMNS, ["date", "account"])
    return raw.select(
        parse_date("date").alias("date"), "account", "account_name", "description",
        parse_amount("debit").alias("debit"), parse_amount("credit").alias("credit"),
        F.nullif("reference", F.lit("")).alias("reference"))


# --------------------------------------------------------------------- listings

# File suffixes by class.
DOCUMENT_SUFFIXES = {"excel": ["xlsx", "xls"], "pdf": ["pdf"], "json": ["json"], "csv": ["csv"]}
MEDIA_SUFFIXES = {"image": ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp"],
                  "audio": ["mp3", "wav", "ogg", "flac", "m4a"], "video": ["mp4", "avi", "mov", "mkv", "webm"]}
FOLDER_TYPES = {"budgets": "budget", "invoices": "invoice", "contracts": "contract", "accounting": "accounting"}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and class of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = None
    for name, suffixes in {**DOCUMENT_SUFFIXES, **MEDIA_SUFFIXES}.items():
        kind = F.when(suffix.isin(suffixes), name) if kind is None else kind.when(suffix.isin(suffixes), name)
    return files.select("path", records.file_stem("path").alias("id"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"), suffix.alias("suffix"),
                        kind.otherwise("other").alias("format"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files of the known folders with the document type their folder stands for."""
    files = listing(spark, path)
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    kind = None
    for name, value in FOLDER_TYPES.items():
        kind = F.when(folder == name, value) if kind is None else kind.when(folder == name, value)
    return files.withColumn("document_type", kind).where("document_type IS NOT NULL")


def route_json(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON file with the type its name, or else its fields, tell."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name"), "value")
    return files.withColumn("document_type", json_type(F.col("file_name"), F.col("value")))


def json_type(name: Column, value: Column) -> Column:
    lower = F.lower(name)

    def by_fields(keys: Column) -> Column:
        def has(k: str) -> Column:
            return F.array_contains(keys, k)

        return (F.when(has("invoice_id") | has("vendor"), "invoice")
                .when(has("contract_id") | has("parties"), "contract")
                .when(has("entry_id") | has("account_code"), "accounting_entry"))

    return (F.when(lower.rlike("invoice|facture"), "invoice").when(lower.rlike("contract|contrat"), "contract")
            .otherwise(let(F.json_object_keys(value), by_fields)))


# --------------------------------------------------------------- contract tables

# Question words and the contract field they ask for.
QUESTION_FIELDS = {"Parties": "vendor", "Agreement Date": "start_date", "Expiration Date": "end_date",
                   "Contract Value": "annual_value", "Auto-Renewal": "auto_renewal", "Contract Type": "type"}
# Answers that say nothing, and the dates of contracts that name none.
NO_ANSWER = ["", "n/a", "none", "not mentioned"]
START_DEFAULT, END_DEFAULT = "2024-01-01", "2026-12-31"


def _value(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def contracts_from_answers(answers: DataFrame, order_by: str = "row_no") -> DataFrame:
    """One contract per file from question-answer rows; a later answer wins.

    ``answers`` has Filename, Question, Answer and an order column.
    """
    given = answers.select(
        F.trim("Filename").alias("file"), F.lower(F.trim("Question")).alias("q"), F.trim("Answer").alias("answer"),
        F.col(order_by).alias("row_no"),
    ).where((F.col("file") != "") & ~F.lower("answer").isin(NO_ANSWER) & F.col("answer").isNotNull())
    fields = [
        F.max_by(F.when(F.col("q").contains(word.lower()), F.col("answer")),
                 F.when(F.col("q").contains(word.lower()), F.col("row_no"))).alias(f)
        for word, f in QUESTION_FIELDS.items()]
    one = given.groupBy("file").agg(F.min("row_no").alias("first_row"), *fields)
    vendor = F.trim(F.regexp_extract("vendor", r"^([^;\n]*)", 1))
    return one.select(
        "file", "first_row", F.coalesce("type", F.lit("SERVICE")).alias("type"),
        F.coalesce(vendor, F.concat(F.lit("Vendor of "), "file")).alias("vendor"),
        norm_date(F.coalesce("start_date", F.lit(START_DEFAULT)), "mdy").alias("start_date"),
        norm_date(F.coalesce("end_date", F.lit(END_DEFAULT)), "mdy").alias("end_date"),
        F.coalesce(_value(F.col("annual_value")), F.lit(0.0)).alias("annual_value"),
        F.coalesce(F.lower("auto_renewal").contains("yes"), F.lit(False)).alias("auto_renewal"))


# Column names a flat contract table may use.
FLAT_COLUMNS = {
    "vendor": ["Party Name", "Vendor", "Company", "Name"],
    "start_date": ["Effective Date", "Start Date", "Agreement Date"],
    "end_date": ["Expiration Date", "End Date", "Termination Date"],
    "annual_value": ["Contract Value", "Annual Value", "Amount"],
}


FLAT_NAMES = [name for names in FLAT_COLUMNS.values() for name in names]


def contracts_from_flat(table: DataFrame) -> DataFrame:
    """Contracts from one row each, under whichever of the known column names exist."""

    def named(field: str, default: str | None) -> Column:
        present = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in FLAT_COLUMNS[field] if c in table.columns]
        return F.coalesce(*present, F.lit(default))

    keep = [c for c in table.columns if c in ("row_no", "source_file")]
    return table.select(
        *keep, F.coalesce(named("vendor", None), F.lit("Unknown Vendor")).alias("vendor"),
        F.lit("SERVICE").alias("type"), norm_date(named("start_date", START_DEFAULT), "mdy").alias("start_date"),
        norm_date(named("end_date", END_DEFAULT), "mdy").alias("end_date"),
        _value(named("annual_value", "0")).alias("annual_value"), F.lit(False).alias("auto_renewal"))
