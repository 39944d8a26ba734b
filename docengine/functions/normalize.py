"""Exact values of raw strings: dates, decimals, ISO currencies, names. Null means invalid; nothing is ever a float."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import collapse, let

#: Two-digit years are those nearest to this year.
PIVOT_YEAR = 2026
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH_NUMBER = {m: i + 1 for i, m in enumerate(MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}


def string(raw: Column) -> Column:
    return collapse(raw)


#: One of the three parts of a date that matches one of the patterns below.
_PART = "[^\\s,./-]+"


def _parts(c: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """``then`` of a date's three parts, found at once; split() would compile its pattern for every row."""
    return let(F.regexp_extract_all(c, F.lit(_PART), F.lit(0)), lambda p: then(*[F.get(p, F.lit(i)) for i in range(3)]))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((y, 4), (m, 2), (d, 2))])
    return F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))


def _year(text: Column, pivot: int) -> Column:
    n = _int(text)
    near = n + 2000
    return F.when(F.length(text) == 2, F.when(near >= pivot + 50, near - 100).otherwise(near)).otherwise(n)


_ISO = "^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})$"
_YEAR_FIRST = _ISO[:-1] + "\\z"
_DAY_FIRST = "^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4})\\z"
_NUMERIC = "^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{2,4})$"
_DAY_MONTH = "^(\\d{1,2})[\\s/-]+([A-Za-z]+)\\.?[\\s,/-]+(\\d{2,4})$"
_MONTH_DAY = "^([A-Za-z]+)\\.?\\s+(\\d{1,2}),?\\s+(\\d{2,4})$"


def date(raw: Column, pivot: int = PIVOT_YEAR) -> Column:
    """The date of a raw string: year first if it begins with four digits, else day first with a month-first repair.
    Incomplete dates are invalid.

    Numbers with a year of four digits, most dates, are put in order and cast in generated code: where day first is no date, month first is
    what the repair gives, or no date either."""
    ordered = lambda pattern, parts: F.regexp_replace(raw, pattern, parts).try_cast("date")
    return (
        F.when(raw.rlike(_DAY_FIRST), F.coalesce(ordered(_DAY_FIRST, "$3-$2-$1"), ordered(_DAY_FIRST, "$3-$1-$2")))
        .when(raw.rlike(_YEAR_FIRST), ordered(_YEAR_FIRST, "$1-$2-$3"))
        .otherwise(let(collapse(raw), lambda c: _date_of(c, pivot)))
    )


def _date_of(c: Column, pivot: int) -> Column:
    def numeric(first: Column, second: Column, last: Column) -> Column:
        a, b, y = _int(first), _int(second), _int(last)
        swapped = (a > 31) & (F.length(last) == 2)
        return (
            F.when(swapped & (y <= 12), _date(_year(first, pivot), y, b))
            .when(swapped, _date(_year(first, pivot), b, y))
            .when((a > 12) | (b <= 12), _date(_year(last, pivot), b, a))
            .otherwise(_date(_year(last, pivot), a, b))
        )

    month = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in _MONTH_NUMBER.items() for v in kv]), F.lower(x))
    return (
        F.when(c.rlike(_ISO), _parts(c, lambda y, m, d: _date(_int(y), _int(m), _int(d))))
        .when(c.rlike("^\\d{4}[-/.]"), F.lit(None).cast("date"))
        .when(c.rlike(_NUMERIC), _parts(c, numeric))
        .when(c.rlike(_DAY_MONTH), _parts(c, lambda d, m, y: _date(_year(y, pivot), month(m), _int(d))))
        .when(c.rlike(_MONTH_DAY), _parts(c, lambda m, d, y: _date(_year(y, pivot), month(m), _int(d))))
    )


def date_adjustment(raw: Column) -> Column:
    """-0.10 where day and month could change places, else 0.05."""
    swaps = lambda a, b, _: (_int(a) <= 12) & (_int(b) <= 12) & (_int(a) != _int(b))
    return let(collapse(raw), lambda c: F.when(c.rlike(_NUMERIC) & _parts(c, swaps), -0.10).otherwise(0.05))


def decimal_text(raw: Column) -> Column:
    """The digits of an amount with a point as decimal separator and its scale as written; null if it isn't a number."""
    c = collapse(F.regexp_replace(collapse(raw), "[£€$¥₹]", ""))
    c = F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]+\\s*", ""), "\\s*[A-Za-z]+$", "")
    c = F.regexp_replace(c, "(?<=\\d)\\s+(?=\\d)", "")
    c = F.when(raw.rlike("^[0-9,.]+\\z"), raw).otherwise(c)  # most amounts, in which none of these finds anything
    number = lambda x: F.when(x.rlike("^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$"), x)
    return let(let(c, lambda x: F.regexp_replace(F.trim(_separated(x)), "(?<=\\d)_(?=\\d)", "")), number)


def _separated(c: Column) -> Column:
    """An amount without thousands separators and with a decimal point."""
    tail = F.length(F.substring_index(c, ",", -1))
    comma, point = c.contains(","), c.contains(".")
    n_commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    without = lambda x, s: F.replace(x, F.lit(s), F.lit(""))
    last_is_point = F.length(F.substring_index(c, ".", -1)) < tail
    return (
        F.when(comma & point & last_is_point, without(c, ","))
        .when(comma & point, F.replace(without(c, "."), F.lit(","), F.lit(".")))
        .when(comma & (n_commas == 1) & (tail <= 2), F.replace(c, F.lit(","), F.lit(".")))
        .when(comma, without(c, ","))
        .otherwise(c)
    )


def decimal(raw: Column) -> Column:
    return decimal_text(raw).try_cast("decimal(38,6)")


def decimal_adjustment(raw: Column) -> Column:
    return F.when(raw.contains(",") & raw.contains("."), -0.10).otherwise(0.05)


def currency(raw: Column) -> Column:
    """An ISO code, or the code of a symbol (R for rand, anywhere in the string)."""
    inside = F.coalesce(*[F.when(raw.contains(s), code) for s, code in {**P.SYMBOLS, "R": "ZAR"}.items()])
    return let(F.upper(collapse(raw)), lambda c: F.when(c.isin(P.KNOWN_CURRENCIES), c).otherwise(F.coalesce(inside, F.when(c.contains("ZAR") | c.contains("RAND"), "ZAR"))))


def currency_adjustment(raw: Column) -> Column:
    return F.when(F.upper(collapse(raw)).isin("$", "USD"), 0.0).otherwise(0.05)


def organization(raw: Column) -> Column:
    """White space collapsed, end punctuation dropped, company suffixes and small words capitalised."""
    c = F.regexp_replace(collapse(raw), "[.,;:!?]+$", "")

    def word(w: Column) -> Column:
        low = F.regexp_replace(F.lower(w), "\\.+$", "")
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        small = w.rlike("\\p{Ll}") & (F.lower(w) == w)
        return F.when(low.isin(P.COMPANY_SUFFIXES), F.when(F.length(low) <= 3, F.upper(w)).otherwise(capital)).when(small, capital).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), word), " ")


#: type -> (value as text, adjustment); dates and decimals also have typed columns.
def normalized(kind: str, raw: Column, pivot: int = PIVOT_YEAR) -> tuple[Column, Column]:
    """(value as text or null if invalid, adjustment of confidence) of a raw value of a field type."""
    if kind == "date":
        return date(raw, pivot).cast("string"), date_adjustment(raw)
    if kind == "decimal":
        return let(decimal_text(raw), lambda c: F.when(c.try_cast("decimal(38,6)").isNotNull(), c)), decimal_adjustment(raw)
    if kind == "currency":
        return currency(raw), currency_adjustment(raw)
    if kind == "organization":
        return organization(raw), F.lit(0.05)
    return string(raw), F.lit(0.05 if kind == "string" else 0.0)
