"""Budget sheets read as tables: column names, header rows, clean-up."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import parse_amount, parse_amount_prefix
from ledgerloom.functions.dates import parse_date

# Words that name a column, by standard column (accents removed).
COLUMN_WORDS = {
    "department": ["department", "departement", "service", "dept"],
    "category": ["category", "categorie", "type", "poste"],
    "budget": ["budget", "budgeted", "budgete", "planned", "prevu"],
    "actual": ["actual", "reel", "spent", "depense"],
    "forecast": ["forecast", "prevision", "estimated", "estime"],
    "variance": ["variance", "ecart", "difference"],
    "period": ["period", "periode", "month", "mois", "date", "quarter", "trimestre"],
    "notes": ["notes", "comments", "commentaires", "remarks"],
}

# Words that give a header row away (accents removed).
HEADER_WORDS = ["department", "departement", "service", "budget", "actual", "reel", "category", "categorie",
                "amount", "montant", "total", "period", "periode", "date"]

ACCENTS = ("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")


def normalise_name(name: str | None) -> str:
    """Lower case, accents and signs removed, blanks as underscores."""
    if name is None:
        return "unnamed"
    flat = unicodedata.normalize("NFKD", name.strip().lower())
    flat = "".join(ch for ch in flat if not unicodedata.combining(ch))
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", flat))


def column_mapping(names: list[str]) -> dict[str, str]:
    """Standard name per column; a second column of the same kind keeps its own name."""
    out: dict[str, str] = {}
    for name in names:
        flat = normalise_name(name)
        standard = next((s for s, words in COLUMN_WORDS.items() if any(w in flat for w in words)), flat)
        out[name] = standard if standard not in out.values() else flat
    return out


def tidy_budget_sheet(sheet: DataFrame, source_file: str = "source_file") -> DataFrame:
    """Rename, drop empty rows, read amounts and periods, add the variance."""
    names = [c for c in sheet.columns if c != source_file]
    df = sheet.na.drop("all", subset=names).withColumnsRenamed(column_mapping(names))
    for c in ("budget", "actual", "forecast", "variance"):
        if c in df.columns:
            df = df.withColumn(c, parse_amount(c))
    if "period" in df.columns:
        df = df.withColumn("period", parse_date("period"))
    if "variance" not in df.columns and {"budget", "actual"} <= set(df.columns):
        gap = F.col("actual") - F.col("budget")
        df = df.withColumn("variance", F.round(gap, 2)).withColumn(
            "variance_percent", F.round(F.try_divide(gap, F.col("budget")) * 100, 2))
    return df


def budget_rows(sheet: DataFrame, default_year: int = 2024) -> DataFrame:
    """Budget rows from a tidied sheet without actuals: the quarters' sum stands in.

    The year comes from the file name.
    """
    quarters = sum((parse_amount_prefix(q) for q in ("q1", "q2", "q3", "q4")), F.lit(0.0))
    actual = F.col("actual") if "actual" in sheet.columns else F.lit(None).cast("double")
    spent = F.round(F.coalesce(F.nullif(actual, F.lit(0.0)), quarters), 2)
    name = F.regexp_extract("source_file", r"([^/]*)/?$", 1)
    year = F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit("")).try_cast("int"),
                      F.lit(default_year))
    return sheet.select(
        F.coalesce("department", F.lit("UNKNOWN")).alias("department"), year.alias("year"),
        F.coalesce("category", F.lit("GENERAL")).alias("category"),
        F.col("budget"), spent.alias("actual"), F.round(spent - F.col("budget"), 2).alias("variance"))


def header_row(texts: DataFrame, id_column: str, text_column: str, separator: str = ";") -> DataFrame:
    """Index of the first row where two cells name a column."""
    words = "|".join(HEADER_WORDS)
    row = F.posexplode(F.split(text_column, "\n")).alias("row", "line")
    cells = F.split(F.translate(F.lower("line"), *ACCENTS), separator)
    hits = F.size(F.filter(cells, lambda c: c.rlike(words)))
    return (
        texts.select(id_column, row).where(hits >= 2)
        .groupBy(id_column).agg(F.min("row").alias("header_row"))
    )
