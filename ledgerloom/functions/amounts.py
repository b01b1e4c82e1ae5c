"""Messy money text to numbers and back, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.bind import let

# Currency symbols and codes in the order they are looked for.
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
CURRENCY_CODES = ["EUR", "USD", "GBP", "JPY", "CHF", "CAD", "AUD", "CNY"]

MONEY = r"([€$£ \t ]*\d[\d.,€$£ \t ]*)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(c: Column | str) -> Column:
    """``1,250.50``, ``1.250,50``, ``€ 1 250,50`` and the like; null when unreadable.

    With both separators the last one is the decimal mark. A lone comma before
    exactly three digits groups thousands, and so do several commas.
    """
    return let(F.regexp_replace(col(c), r"[^0-9.,\-]", ""), _read_digits)


def _read_digits(digits: Column) -> Column:
    dots, commas = digits.contains("."), digits.contains(",")
    no_commas = F.replace(digits, F.lit(","), F.lit(""))
    comma_decimal = F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", ".")
    plain = (
        F.when(~commas, digits)
        .when(dots & ~F.substring_index(digits, ",", -1).contains("."), comma_decimal)
        .when(dots | digits.rlike(r",\d{3}$|,.*,"), no_commas)
        .otherwise(F.translate(digits, ",", "."))
    )
    # a cast that fails costs more than all the rest
    return F.when(digits != "", F.round(plain.try_cast("double"), 2))


def parse_number(c: Column | str) -> Column:
    """A plain number keeps all its digits; anything else is read as an amount."""
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return let(F.trim(col(c)), lambda text: F.when(text.rlike(plain), text.try_cast("double")).otherwise(
        parse_amount(text)))


def parse_amount_prefix(c: Column | str) -> Column:
    """The number a text starts with, commas dropped; 0 when there is none."""
    text = F.trim(F.replace(col(c), F.lit(","), F.lit("")))
    return F.coalesce(F.regexp_extract(text, r"^[-+]?\d*\.?\d+", 0).try_cast("double"), F.lit(0.0))


def detect_currency(c: Column | str) -> Column:
    """Symbol first, then ISO code, else EUR; UNKNOWN for no text at all."""
    text = col(c)
    out = F.when(F.coalesce(text, F.lit("")) == "", "UNKNOWN")
    for symbol, code in CURRENCY_SYMBOLS.items():
        out = out.when(text.contains(symbol), code)
    out = out.when(text.contains(CURRENCY_CODES[0]) & ~text.contains("Fr"), CURRENCY_CODES[0])  # no capitals needed
    out = out.when(text.contains("Fr") & text.rlike(r"(?<![A-Za-z])Fr(?![A-Za-z])"), "CHF")

    def by_code(upper: Column) -> Column:
        found = None
        for code in CURRENCY_CODES:
            found = F.when(upper.contains(code), code) if found is None else found.when(upper.contains(code), code)
        return found.otherwise("EUR")

    return out.otherwise(let(F.upper(text), by_code))


def parse_tax_rate(c: Column | str) -> Column:
    """The first percentage as a fraction."""
    text = col(c)
    return F.when(text.contains("%"), F.round(
        F.regexp_extract(text, r"(\d(?<!\d\d)\d*+\.?+\d*+)\s*+%", 1).try_cast("double") / 100, 4))


def gross(net: Column, rate: Column) -> Column:
    return F.round(net * (1 + rate), 2)


def net(gross_amount: Column, rate: Column) -> Column:
    return F.round(F.try_divide(gross_amount, 1 + rate), 2)


def _present(c: Column) -> Column:
    """An amount of zero counts as absent."""
    return F.nullif(c, F.lit(0.0))


def complete_totals(ht: Column, rate: Column, ttc: Column, tax: Column) -> Column:
    """Struct of ``ht``, ``ttc`` and ``tax`` with the missing one derived from the other two."""
    given = F.struct(ht.alias("ht"), _present(rate).alias("rate"), ttc.alias("ttc"), tax.alias("tax"))

    def with_gross(g: Column) -> Column:
        full = F.coalesce(_present(g["ttc"]), gross(_present(g["ht"]), g["rate"]), g["ttc"])
        return let(F.struct(g["ht"].alias("ht"), g["rate"].alias("rate"), full.alias("ttc"), g["tax"].alias("tax")),
                   with_net)

    def with_net(g: Column) -> Column:
        full = F.coalesce(_present(g["ht"]), net(_present(g["ttc"]), g["rate"]), g["ht"])
        return let(F.struct(full.alias("ht"), g["ttc"].alias("ttc"), g["tax"].alias("tax")), with_tax)

    def with_tax(g: Column) -> Column:
        full = F.coalesce(_present(g["tax"]), F.round(_present(g["ttc"]) - _present(g["ht"]), 2), g["tax"])
        return F.struct(g["ht"].alias("ht"), g["ttc"].alias("ttc"), full.alias("tax"))

    return let(given, with_gross)


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that matches; null when none does."""
    return F.coalesce(*[let(F.regexp_extract(text, p, group), lambda x: F.when(x != "", x)) for p in patterns])


def folded(text: Column, lower: Column) -> Column:
    """The lowered text, as long as the text, in which a word stands wherever its pattern in any case fits: three letters have
    only their capital or their small form in common with s and i."""
    odd = text.contains("ſ") | text.contains("ı") | text.contains("İ")
    return F.when(odd, F.lower(F.translate(text, "ſıİ", "sii"))).otherwise(lower)


def first_named(text: Column, small: Column, patterns: list[tuple[str, str]]) -> Column:
    """:func:`first_match` of patterns that begin with a word; the text is searched from where its :func:`folded` form has it."""
    def found(word: str, pattern: str) -> Column:
        # to learn that a word is missing costs a tenth of finding its place
        return F.when(small.contains(word), let(
            F.regexp_extract(F.substr(text, F.instr(small, word)), pattern, 1), lambda x: F.when(x != "", x)))

    return F.coalesce(*[found(*p) for p in patterns])


# What amounts in a text are named by, with the beginning of each, lowered.
NET_PATTERNS = [("ht", rf"(?i)HT\s*:?\s*{MONEY}"), ("net", rf"(?i)net\s*:?\s*{MONEY}")]
GROSS_PATTERNS = [("ttc", rf"(?i)TTC\s*:?\s*{MONEY}"), ("total", rf"(?i)total\s*:?\s*{MONEY}"),
                  ("amount", rf"(?i)amount\s*due\s*:?\s*{MONEY}")]
TAX_PATTERNS = [("tva", rf"(?i)TVA\s*:?\s*{MONEY}"), ("vat", rf"(?i)VAT\s*:?\s*{MONEY}"),
                ("tax", rf"(?i)tax\s*amount\s*:?\s*{MONEY}")]


def extract_amounts(c: Column | str) -> Column:
    """Net, gross, tax, rate and currency named in a free text, as one struct."""
    return let(folded(col(c), F.lower(col(c))), lambda small: amounts_in(col(c), small))


def amounts_in(text: Column, small: Column) -> Column:
    """:func:`extract_amounts` of a text whose :func:`folded` form is at hand."""
    def amount(patterns: list[tuple[str, str]]) -> Column:
        return let(first_named(text, small, patterns), lambda x: F.when(x.isNotNull(), parse_amount(x)))

    ht, ttc, tax = (amount(p) for p in (NET_PATTERNS, GROSS_PATTERNS, TAX_PATTERNS))
    rate, currency = parse_tax_rate(text), detect_currency(text)
    return let(
        F.struct(complete_totals(ht, rate, ttc, tax).alias("t"), rate.alias("r")),
        lambda x: F.struct(x["t"]["ht"].alias("amount_ht"), x["t"]["ttc"].alias("amount_ttc"),
                           x["r"].alias("tax_rate"), x["t"]["tax"].alias("tax_amount"),
                           currency.alias("currency")))


def format_amount(c: Column | str, currency: Column, locale: str = "fr") -> Column:
    """``1 250,50 EUR`` in French, ``€1,250.50`` in English."""
    text = F.format_number(col(c), 2)
    if locale == "fr":
        return F.concat(F.translate(text, ",.", " ,"), F.lit(" "), currency)
    out = None
    for symbol, code in list(CURRENCY_SYMBOLS.items())[:3]:
        signed = F.concat(F.lit(symbol), text)
        out = F.when(currency == code, signed) if out is None else out.when(currency == code, signed)
    return out.otherwise(F.concat(text, F.lit(" "), currency))
