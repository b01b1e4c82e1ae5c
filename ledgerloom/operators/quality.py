"""Validation rules. Every rule yields a code and a sentence; errors make a row invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# VAT rates taken as usual.
USUAL_RATES = [0.0, 0.055, 0.10, 0.20, 0.21]


def _finding(when: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.cast("string").alias("message")))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])


def _judged(df: DataFrame, errors: list[Column], warnings: list[Column], more: Column | None = None) -> DataFrame:
    warn = F.array_compact(F.array(*warnings))
    if more is not None:
        warn = F.concat(warn, more)
    return df.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": warn}).withColumn(
        "is_valid", F.size("errors") == 0)


def _missing(names: list[str]) -> list[Column]:
    return [_finding(F.col(n).isNull(), f"missing_{n}", f"Missing required field: {n}") for n in names]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def validate_invoices(invoices: DataFrame) -> DataFrame:
    """Rules over ``invoice_id, vendor, client, date, due_date, total_ht, tax_rate, total_ttc, items``.

    ``vendor`` and ``client`` are names or structs with a ``name``.
    """

    def name(c: str) -> Column:
        return F.col(f"{c}.name") if invoices.schema[c].dataType.typeName() == "struct" else F.col(c)

    ht, rate, ttc = F.col("total_ht"), F.col("tax_rate"), F.col("total_ttc")
    expected = F.round(ht * (1 + rate), 2)
    usual = F.lit(False)
    for r in USUAL_RATES:
        usual = usual | (F.abs(rate - r) < 0.001)
    errors = _missing(["invoice_id", "vendor", "total_ttc"]) + [
        _finding(ttc < 0, "negative_ttc", _say("Total TTC cannot be negative: ", ttc)),
        _finding(ht < 0, "negative_ht", _say("Total HT cannot be negative: ", ht)),
        _finding((rate < 0) | (rate > 1), "tax_rate_range", _say("Tax rate should be between 0 and 1 (got ", rate, ")")),
        _finding(F.col("due_date") < F.col("date"), "due_before_date",
                 _say("Due date (", F.col("due_date"), ") cannot be before invoice date (", F.col("date"), ")")),
        _finding(_blank(name("vendor")), "vendor_name_missing", "Vendor name is missing"),
    ]
    warnings = [
        _finding(F.length("invoice_id") < 3, "short_id", _say("Invoice ID '", F.col("invoice_id"), "' seems too short")),
        _finding(ttc == 0, "zero_ttc", "Total TTC is zero"),
        _finding(F.abs(expected - F.round(ttc, 2)) > 0.1, "amount_inconsistency",
                 _say("Amount inconsistency: HT and rate give ", expected, ", but TTC=", ttc)),
        _finding(~usual, "unusual_rate", _say("Unusual tax rate: ", rate)),
        _finding(_blank(name("client")), "client_name_missing", "Client name is missing"),
    ]

    def item_findings(item: Column, i: Column) -> Column:
        at = _say("Line item ", i + 1)
        return F.array_compact(F.array(
            _finding(_blank(item["description"]), "item_description", F.concat(at, F.lit(" missing description"))),
            _finding(item["quantity"] <= 0, "item_quantity", F.concat(at, F.lit(" has invalid quantity"))),
            _finding(item["unit_price"] < 0, "item_price", F.concat(at, F.lit(" has negative unit price"))),
        ))

    of_items = F.coalesce(F.flatten(F.transform("items", item_findings)),
                          F.array().cast("array<struct<code:string,message:string>>"))
    return _judged(invoices, errors, warnings, of_items)


def validate_contracts(contracts: DataFrame) -> DataFrame:
    """Rules over ``contract_id, title, start_date, end_date, amount, parties``."""
    amount, people = F.col("amount"), F.col("parties")
    errors = _missing(["contract_id", "title", "start_date", "parties"]) + [
        _finding(F.col("end_date") < F.col("start_date"), "end_before_start",
                 _say("End date (", F.col("end_date"), ") cannot be before start date (", F.col("start_date"), ")")),
        _finding(amount < 0, "negative_amount", _say("Contract amount cannot be negative: ", amount)),
        _finding(F.coalesce(F.size(people), F.lit(0)) <= 0, "no_party", "Contract must have at least one party"),
    ]
    warnings = [
        _finding(amount == 0, "zero_amount", "Contract amount is zero"),
        _finding(F.size(people) == 1, "one_party", "Contract typically has at least two parties"),
        _finding((F.size(people) > 0) & F.forall(people, lambda p: p["role"] == "UNKNOWN"), "no_roles",
                 "No party roles identified"),
    ]
    return _judged(contracts, errors, warnings)


def validate_budgets(budgets: DataFrame) -> DataFrame:
    """Rules over ``department, budget, actual, variance``."""
    b, a, v = F.col("budget"), F.col("actual"), F.col("variance")
    errors = _missing(["department", "budget"]) + [
        _finding(b < 0, "negative_budget", _say("Budget amount cannot be negative: ", b)),
        _finding(F.abs((a - b) - v) > 0.01, "variance_inconsistency",
                 _say("Variance inconsistency: ", a, " - ", b, " = ", a - b, ", but variance=", v)),
    ]
    warnings = [_finding(a < 0, "negative_actual", _say("Actual amount is negative (possible refund?): ", a))]
    return _judged(budgets, errors, warnings)


def validate_date_range(df: DataFrame, start: str, end: str, max_days: int = 365 * 5) -> DataFrame:
    s, e = F.col(start), F.col(end)
    days = F.datediff(e, s)
    return _judged(
        df,
        [_finding(e < s, "end_before_start", _say("End date (", e, ") before start date (", s, ")")),
         _finding(days < 0, "negative_range", _say("Negative date range: ", days, " days"))],
        [_finding(s.isNull() & e.isNull(), "no_dates", "Both dates are missing"),
         _finding(days > max_days, "range_too_long",
                  _say("Date range (", days, f" days) exceeds maximum ({max_days} days)"))])


def validate_amount_range(df: DataFrame, amount: str, low: float = 0.0, high: float | None = None) -> DataFrame:
    x = F.col(amount)
    warnings = [_finding(x.isNull(), "no_amount", "Amount is missing")]
    if high is not None:
        warnings.append(_finding(x > high, "above_maximum", _say("Amount ", x, f" exceeds maximum {high}")))
    return _judged(df, [_finding(x < low, "below_minimum", _say("Amount ", x, f" is below minimum {low}"))], warnings)


def codes(findings: str) -> Column:
    return F.array_join(F.transform(findings, lambda f: f["code"]), ",")


def validation_summary(judged: DataFrame) -> DataFrame:
    """Totals over the output of one of the validators."""
    return judged.agg(
        F.count("*").alias("total_documents"),
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("total_warnings"))


def unique_keys(named: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows, distinct keys and keys held by several rows, per table."""
    out = None
    for label, (df, keys) in named.items():
        one = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct_keys"),
            F.count_if(F.col("c") > 1).alias("repeated_keys"),
        ).select(F.lit(label).alias("label"), "n", "distinct_keys", "repeated_keys")
        out = one if out is None else out.unionByName(one)
    return out


def missing_fields(json_text: Column, required: list[str]) -> Column:
    """Required fields that a JSON object does not have."""
    keys = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(r) for r in required]), keys)


def budget_issues(budgets: DataFrame) -> DataFrame:
    """One row per kind of trouble in a budget table; ``n`` is the rows or pairs it touches."""
    rows: list[Column] = []

    def issue(severity: str, column: str, code: str, n: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(column).alias("column"), F.lit(code).alias("issue"),
                        n.cast("bigint").alias("n"))

    fixed = [issue("ERROR", c, "missing_column", F.lit(1)) for c in ("department", "budget") if c not in budgets.columns]
    present = [c for c in ("department", "budget", "actual") if c in budgets.columns]
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    rows += [issue("WARNING", c, "null_values", F.col(f"null_{c}")) for c in present]
    if "budget" in budgets.columns:
        counts.append(F.count_if(F.col("budget") < 0).alias("negative"))
        rows.append(issue("WARNING", "budget", "negative_values", F.col("negative")))
    out = budgets.agg(*counts).select(F.inline(F.array(*rows, *fixed)))
    if {"department", "period"} <= set(budgets.columns):
        again = (
            budgets.groupBy("department", "period").agg(F.count("*").alias("c")).where("c > 1")
            .agg(F.count("*").alias("pairs"))
            .select(F.inline(F.array(issue("WARNING", "department", "repeated_period", F.col("pairs")))))
        )
        out = out.unionByName(again)
    return out.where("n > 0")
