"""Normalising parsed records: aliases, parties, items, clauses and totals.

A field that files write either as text or as an object is read as a string;
Spark's JSON reader then hands over an object's text, which is opened here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.bind import let
from ledgerloom.functions.amounts import complete_totals, detect_currency, parse_number
from ledgerloom.functions.dates import parse_date

PARTY_FIELDS = ["name", "company_name", "address", "siret", "company_id", "vat_number", "tva", "role",
                "representative", "signatory"]
ITEM_FIELDS = ["description", "label", "quantity", "qty", "unit_price", "price", "rate", "total", "amount", "subtotal"]
CLAUSE_FIELDS = ["type", "description", "text", "value"]

INVOICE_FIELDS = [
    "invoice_id", "id", "number", "date", "invoice_date", "issue_date", "due_date", "payment_due", "deadline",
    "vendor", "supplier", "from", "client", "customer", "to",
    "total_ht", "subtotal", "subtotal_ht", "amount_ht", "net_amount", "total_before_tax",
    "tax_rate", "vat_rate", "tva_rate", "tax_amount", "vat_amount", "tva_amount", "tax",
    "total_ttc", "total", "amount_ttc", "total_amount", "amount_due", "grand_total",
    "currency", "devise", "payment_terms", "terms", "payment_method", "method", "status",
    "notes", "comments", "reference", "po_number"]
CONTRACT_FIELDS = [
    "contract_id", "id", "number", "title", "name", "description", "start_date", "effective_date",
    "commencement_date", "end_date", "expiry_date", "termination_date", "vendor",
    "amount", "total_amount", "contract_value", "value", "annual_value", "currency",
    "billing_frequency", "payment_schedule", "payment_terms_days", "payment_terms", "net_days",
    "auto_renew", "auto_renewal", "renewal_notice_days", "notice_period_days", "status", "category", "type",
    "notes", "comments"]
ENTRY_FIELDS = [
    "entry_id", "id", "date", "entry_date", "transaction_date", "description", "label", "account_code", "account",
    "debit", "debit_amount", "credit", "credit_amount", "category", "type", "reference", "document_ref", "notes"]


def _strings(fields: list[str]) -> str:
    return ", ".join(f"`{f}` string" for f in fields)


def _struct(fields: list[str]) -> str:
    return "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"


_ITEMS = f"array<{_struct(ITEM_FIELDS)}>"
INVOICE_SCHEMA = f"{_strings(INVOICE_FIELDS)}, items {_ITEMS}, `lines` {_ITEMS}, line_items {_ITEMS}"
CONTRACT_SCHEMA = (f"{_strings(CONTRACT_FIELDS)}, parties array<string>, signatories array<string>, "
                   "clauses array<string>, terms array<string>")
ENTRY_SCHEMA = _strings(ENTRY_FIELDS)


def first_text(*cols: Column | str, default: str | Column | None = None) -> Column:
    """The first column that holds a non-empty text."""
    found = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    if default is not None:
        found.append(F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(*found)


def _where_given(cols: tuple[Column | str, ...], read: Callable[[Column], Column]) -> list[Column]:
    """``read`` over each column; the many names that a record lacks cost no reading."""
    given = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [F.when(c.isNotNull() & (c != ""), read(c)) for c in given]


def first_number(*cols: Column | str, default: float | None = None) -> Column:
    found = _where_given(cols, parse_number)
    if default is not None:
        found.append(F.lit(float(default)))
    return F.coalesce(*found)


def first_date(*cols: Column | str) -> Column:
    return F.coalesce(*_where_given(cols, parse_date))


def as_fraction(rate: Column) -> Column:
    """A rate above one is a percentage."""
    return F.when(rate > 1, rate / 100).otherwise(rate)


def _is_object(c: Column) -> Column:
    return F.ltrim(c).startswith("{")


def _opened(c: Column, fields: list[str]) -> Column:
    return F.from_json(F.when(_is_object(c), c), _struct(fields))


def _party_name(c: Column, o: Column) -> Column:
    return F.coalesce(F.when(~_is_object(c), F.nullif(c, F.lit(""))),
                      first_text(o["name"], o["company_name"]), F.lit("UNKNOWN"))


def party(c: Column) -> Column:
    """Vendor or client, given as a name or as an object, as one struct."""

    def build(x: Column) -> Column:
        o = x["o"]
        return F.struct(_party_name(x["c"], o).alias("name"), o["address"].alias("address"),
                        first_text(o["siret"], o["company_id"]).alias("siret"),
                        first_text(o["vat_number"], o["tva"]).alias("vat_number"))

    return let(F.struct(c.alias("c"), _opened(c, PARTY_FIELDS).alias("o")), build)


def parties(c: Column) -> Column:
    """Signing parties with their roles; a bare name has the role UNKNOWN."""

    def build(x: Column) -> Column:
        o = x["o"]
        return F.struct(_party_name(x["c"], o).alias("name"), F.upper(F.coalesce(o["role"], F.lit("UNKNOWN"))).alias("role"),
                        o["address"].alias("address"),
                        first_text(o["representative"], o["signatory"]).alias("representative"))

    opened = F.transform(c, lambda p: F.struct(p.alias("c"), _opened(p, PARTY_FIELDS).alias("o")))
    return F.transform(opened, build)


def provider(parties_col: Column, vendor: Column) -> Column:
    """The providing party's name, else the first party's, else the vendor's."""
    giving = F.filter(parties_col, lambda p: p["role"].isin("PROVIDER", "VENDOR", "SUPPLIER"))
    return F.coalesce(F.try_element_at(giving, F.lit(1))["name"],
                      F.try_element_at(parties_col, F.lit(1))["name"], vendor, F.lit("UNKNOWN"))


def clauses(c: Column) -> Column:
    """Clauses with type, description and value; a bare text is of type GENERAL."""

    def build(x: Column) -> Column:
        o = x["o"]
        text = F.coalesce(F.when(~_is_object(x["c"]), x["c"]), first_text(o["description"], o["text"]),
                          F.lit("NO DESCRIPTION"))
        return F.struct(F.upper(F.coalesce(o["type"], F.lit("GENERAL"))).alias("type"), text.alias("description"),
                        o["value"].alias("value"))

    opened = F.transform(c, lambda x: F.struct(x.alias("c"), _opened(x, CLAUSE_FIELDS).alias("o")))
    return F.transform(opened, build)


def items(c: Column) -> Column:
    """Line items with numbers read and a missing total worked out."""

    def read(x: Column) -> Column:
        return F.struct(first_text(x["description"], x["label"], default="NO DESCRIPTION").alias("description"),
                        first_number(x["quantity"], x["qty"], default=1.0).alias("quantity"),
                        first_number(x["unit_price"], x["price"], x["rate"]).alias("unit_price"),
                        first_number(x["total"], x["amount"], x["subtotal"]).alias("total"))

    return F.transform(F.transform(c, read), lambda i: F.struct(
        i["description"].alias("description"), i["quantity"].alias("quantity"), i["unit_price"].alias("unit_price"),
        F.coalesce(i["total"], i["quantity"] * i["unit_price"]).alias("total")))


def _filled(*cols: str) -> Column:
    """The first list with entries, else an empty one."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in cols], F.col(cols[0]))


def file_stem(c: Column | str) -> Column:
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/]+?)(\.[^./]*)?$", 1)


def normalise_invoices(raw: DataFrame) -> DataFrame:
    """Canonical invoices from rows of ``INVOICE_SCHEMA`` plus ``source_file``."""
    rate = as_fraction(first_number("tax_rate", "vat_rate", "tva_rate"))
    ht = first_number("total_ht", "subtotal", "subtotal_ht", "amount_ht", "net_amount", "total_before_tax")
    ttc = first_number("total_ttc", "total", "amount_ttc", "total_amount", "amount_due", "grand_total")
    tax = first_number("tax_amount", "vat_amount", "tva_amount", "tax")
    read = raw.select(
        "source_file",
        first_text("invoice_id", "id", "number", default=F.concat(F.lit("UNKNOWN_"), file_stem("source_file")))
        .alias("invoice_id"),
        first_date("date", "invoice_date", "issue_date").alias("date"),
        first_date("due_date", "payment_due", "deadline").alias("due_date"),
        party(first_text("vendor", "supplier", "from")).alias("vendor"),
        party(first_text("client", "customer", "to")).alias("client"),
        items(_filled("items", "lines", "line_items")).alias("items"),
        ht.alias("ht"), rate.alias("tax_rate"), ttc.alias("ttc"), tax.alias("tax"),
        F.upper(first_text("currency", "devise", default=detect_currency(F.coalesce("total_ttc", F.lit("")))))
        .alias("currency"),
        first_text("payment_terms", "terms").alias("payment_terms"),
        first_text("payment_method", "method").alias("payment_method"),
        F.upper(F.coalesce("status", F.lit("UNPAID"))).alias("status"),
        first_text("notes", "comments").alias("notes"),
        first_text("reference", "po_number").alias("reference"),
    )
    full = complete_totals(F.col("ht"), F.col("tax_rate"), F.col("ttc"), F.col("tax"))
    return (
        read.withColumn("t", full)
        .withColumns({"total_ht": F.col("t.ht"), "total_ttc": F.col("t.ttc"), "tax_amount": F.col("t.tax"),
                      "document_type": F.lit("invoice")})
        .drop("ht", "ttc", "tax", "t")
    )


def normalise_contracts(raw: DataFrame) -> DataFrame:
    """Canonical contracts from rows of ``CONTRACT_SCHEMA`` plus ``source_file``."""
    people = F.col("people")
    vendor = party(first_text("vendor"))["name"]
    return raw.withColumn("people", parties(_filled("parties", "signatories"))).select(
        "source_file",
        first_text("contract_id", "id", "number", default=F.concat(F.lit("CONTRACT_"), file_stem("source_file")))
        .alias("contract_id"),
        first_text("title", "name", "description", default="Untitled Contract").alias("title"),
        first_date("start_date", "effective_date", "commencement_date").alias("start_date"),
        first_date("end_date", "expiry_date", "termination_date").alias("end_date"),
        people.alias("parties"),
        provider(people, vendor).alias("vendor"),
        first_number("amount", "total_amount", "contract_value", "value").alias("amount"),
        first_number("annual_value", "amount", default=0.0).alias("annual_value"),
        F.upper(first_text("currency", default="EUR")).alias("currency"),
        first_text("billing_frequency", "payment_schedule").alias("billing_frequency"),
        first_number("payment_terms_days", "payment_terms", "net_days", default=30).alias("payment_terms_days"),
        clauses(_filled("clauses", "terms")).alias("clauses"),
        F.coalesce(F.coalesce("auto_renewal", "auto_renew").try_cast("boolean"), F.lit(False)).alias("auto_renewal"),
        first_number("renewal_notice_days", "notice_period_days", default=90).alias("renewal_notice_days"),
        F.upper(F.coalesce("status", F.lit("ACTIVE"))).alias("status"),
        first_text("type", "category", default="SERVICE").alias("type"),
        first_text("notes", "comments").alias("notes"),
        F.lit("contract").alias("document_type"),
    )


def normalise_entries(raw: DataFrame) -> DataFrame:
    """Canonical ledger entries from rows of ``ENTRY_SCHEMA`` plus ``source_file``."""
    return raw.select(
        "source_file",
        first_text("entry_id", "id", default=F.concat(F.lit("ENTRY_"), file_stem("source_file"))).alias("entry_id"),
        first_date("date", "entry_date", "transaction_date").alias("date"),
        first_text("description", "label", default="NO DESCRIPTION").alias("description"),
        first_text("account_code", "account").alias("account_code"),
        first_number("debit", "debit_amount", default=0.0).alias("debit"),
        first_number("credit", "credit_amount", default=0.0).alias("credit"),
        first_text("category", "type").alias("category"),
        first_text("reference", "document_ref").alias("reference"),
        F.col("notes"),
        F.lit("accounting_entry").alias("document_type"),
    )
