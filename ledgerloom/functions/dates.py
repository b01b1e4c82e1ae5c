"""Messy date text to dates and back, as native column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import col
from ledgerloom.functions.bind import let

# Month names in calendar order, and French short forms.
ENGLISH = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
           "october", "november", "december"]
FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre",
          "octobre", "novembre", "décembre"]
ENGLISH_NUMBERS = {n: i for i, m in enumerate(ENGLISH, 1) for n in (m, m[:3])}
FRENCH_NUMBERS = {m: i for i, m in enumerate(FRENCH, 1)}
FRENCH_SHORT = {"janv": 1, "févr": 2, "avr": 4, "juil": 7, "sept": 9, "oct": 10, "nov": 11, "déc": 12}

# The forms of a date in a text. No two of them fit at one place, so those that begin with a digit share
# their first digits; a written month is tried from the start of its word only, once per word
DIGIT_FIRST = r"(?U)\d(?:\d(?:/\d{2}/\d{4}|\.\d{2}\.\d{4}|-\d{2}-\d{4}|\d{2}-\d{2}-\d{2})|\d? \w++ \d{4})"
DATE_PATTERN = DIGIT_FIRST + r"|(?:(?<!\w)|\G)\w++ \d{1,2}, \d{4}"


def ymd(y: Column, m: Column, d: Column) -> Column:
    """A date from a year of four digits, month and day; null when there is no such day."""
    dash = F.lit("-")
    return F.concat(y, dash, m, dash, d).try_cast("date")


def _month_number(name: Column, numbers: dict[str, int]) -> Column:
    table = ", ".join(f"'{n}', {i}" for n, i in numbers.items())
    return F.try_element_at(F.expr(f"map({table})"), name)


def _english_month(name: Column) -> Column:
    return _month_number(name, ENGLISH_NUMBERS)


def _french_month(lower: Column) -> Column:
    """The month whose name stands anywhere in the text."""
    names = FRENCH_NUMBERS | FRENCH_SHORT
    return _month_number(F.regexp_extract(lower, "(" + "|".join(names) + ")", 1), names)


def _groups(text: Column, pattern: str, n: int, build) -> Column:
    """``build`` over the pattern's groups where the text matches; null elsewhere."""
    return F.when(text.rlike(pattern), build(*[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)]))


def parse_date(c: Column | str, prefer_european: bool = True) -> Column:
    """ISO, dotted, slashed, dashed and written dates in English and French.

    A slashed date is read day first (or month first) and turned round when the
    month would be above 12. Two-digit years from 69 on belong to the 1900s.
    """

    def iso(text: Column) -> Column:
        return ymd(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2))

    def numeric(text: Column) -> Column:
        a, sign, b = F.substring(text, 1, 2), F.substring(text, 3, 1), F.substring(text, 4, 2)
        return let(F.regexp_extract(F.substring(text, 7, 4), r"^\d+", 0), lambda y: by_place(a, sign, b, y))

    def by_place(a: Column, sign: Column, b: Column, y: Column) -> Column:
        year = F.when(F.length(y) == 4, y).when(y >= "69", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
        month, other = (b, a) if prefer_european else (a, b)
        turned = (month > "12") & (other <= "12")
        slashed = F.when(turned, ymd(year, other, month)).otherwise(ymd(year, month, other))
        return F.when(sign == "/", slashed).otherwise(ymd(year, b, a))

    def french(text: Column) -> Column:
        def build(n: Column) -> Column:
            day, year = F.get(n, F.lit(0)), F.get(n, F.lit(1))
            full = F.when(F.length(year) == 4, year.try_cast("int")).when(
                F.length(year) < 4, year.try_cast("int") + 2000)
            return F.when(F.length(day) <= 2, ymd(F.lpad(full.cast("string"), 4, "0"), _french_month(text), day))

        return let(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), build)

    def worded(parts: Column) -> Column:
        day, month, year = (F.get(parts, F.lit(i)) for i in range(3))
        return ymd(F.substring(year, 1, 4), _month_number(month, ENGLISH_NUMBERS | FRENCH_NUMBERS), day)

    def read(text: Column) -> Column:
        return F.coalesce(
            # the places of these are fixed, but for the length of the year at the end
            F.when(text.rlike(r"^(\d{4})([-/])(\d{2})\2(\d{2})$"), iso(text)),
            F.when(text.rlike(r"^(\d{2})([./-])(\d{2})\2(\d{4}|(?<=[.-])\d{2})$"), numeric(text)),
            _groups(text, r"^([a-z]+) (\d{1,2}), (\d{4})$", 3, lambda m, d, y: ymd(y, _english_month(m), d)),
            F.when(text.rlike(r"^\d{1,2} [a-zéû]+ \d{4}$"), let(F.split(text, " "), worded)),
            F.when(text.rlike(r"[a-z]"), french(text)),
        )

    return let(F.lower(F.trim(col(c))), read)


def relative_date(c: Column | str, as_of: dt.date) -> Column:
    """``Q1 2024``, ``H2 2024``, ``net 30``, end of month or year, against ``as_of``."""
    day = F.lit(as_of)

    def read(text: Column) -> Column:
        days = F.when(text.rlike("net|days|jours"), F.regexp_extract(text, r"(\d+)", 1).try_cast("int"))
        return F.coalesce(
            _groups(text, r"q([1-4])\s*(\d{4})", 2, lambda q, y: F.last_day(ymd(y, q.cast("int") * 3, F.lit("1")))),
            _groups(text, r"h([12])\s*(\d{4})", 2, lambda h, y: F.last_day(ymd(y, h.cast("int") * 6, F.lit("1")))),
            F.when(days < 1000000, F.date_add(day, days)),
            F.when(text.rlike("end of month|fin de mois|eom"), F.last_day(day)),
            F.when(text.rlike("end of year|fin d'année|eoy"), F.lit(dt.date(as_of.year, 12, 31))),
        )

    return let(F.lower(F.trim(col(c))), read)


def extract_dates(c: Column | str, prefer_european: bool = True) -> Column:
    """Every readable date of a text, in the order of the text."""
    text = col(c)
    # a month before its day is followed by a comma, so most texts need no look at every word
    found = F.when(text.contains(", "), F.regexp_extract_all(text, F.lit(DATE_PATTERN), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(DIGIT_FIRST), F.lit(0)))
    return F.filter(F.transform(found, lambda x: parse_date(x, prefer_european)), lambda x: x.isNotNull())


def in_order(start: Column, end: Column) -> Column:
    return start < end


def is_overdue(due: Column, as_of: dt.date) -> Column:
    return due < F.lit(as_of)


def payment_delay(invoiced: Column, paid: Column, terms: int = 30) -> Column:
    """Days beyond the terms; late when above zero."""
    return F.datediff(paid, F.date_add(invoiced, terms))


def format_date(c: Column | str, style: str = "iso") -> Column:
    d = col(c)
    if style == "french":
        month = F.element_at(F.array(*[F.lit(m) for m in FRENCH]), F.month(d))
        return F.concat_ws(" ", F.day(d).cast("string"), month, F.year(d).cast("string"))
    return F.date_format(d, {"iso": "yyyy-MM-dd", "european": "dd/MM/yyyy", "american": "MM/dd/yyyy"}[style])


def fiscal_year(c: Column | str, start_month: int = 1) -> Column:
    d = col(c)
    return F.year(d) - (F.month(d) < start_month).cast("int")


def norm_date(c: Column | str, order: str = "dmy", fallback: dt.date | None = None) -> Column:
    """Contract dates: ISO, numeric in the given order, or with an English month name."""

    def numeric(a: Column, b: Column, y: Column) -> Column:
        d, m = (a, b) if order == "dmy" else (b, a)
        return ymd(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), m, d)

    def read(text: Column) -> Column:
        return F.coalesce(
            _groups(text, r"^(\d{4})-(\d{2})-(\d{2})", 3, ymd),
            _groups(text, r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4}|\d{2})$", 3, numeric),
            _groups(text, r"^([a-z]+)\s+(\d{1,2}),?\s*(\d{4})", 3, lambda m, d, y: ymd(y, _english_month(m), d)),
            _groups(text, r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})", 3, lambda d, m, y: ymd(y, _english_month(m), d)),
            F.lit(fallback).cast("date"),
        )

    return let(F.lower(F.trim(col(c))), read)
