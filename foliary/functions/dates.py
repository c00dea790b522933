"""Dates and years written as free text, read by native expressions.

``as_of`` is always passed in; nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import strip

# Fixed values.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
ORDINAL_SUFFIX = r"(\d+)(st|nd|rd|th)"
YEAR_AT_END = r"\(?(\d{4})\)?$"
YEAR_AFTER, YEAR_BEFORE = 1900, 2100
PIVOT_BUFFER = 10

_MONTH_NAMES = "(?i:" + "|".join(MONTHS) + ")"
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"


def _iso(year: Column, month: Column, day: Column) -> Column:
    """A date from number texts, or null when there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.cast("int") > 0, F.try_to_date(text, "yyyy-MM-dd"))


def _match(c: Column, pattern: str, *groups: int) -> tuple[Column, list[Column]]:
    return c.rlike(pattern), [F.regexp_extract(c, pattern, g) for g in groups]


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string")


def _iso_date(c: Column) -> Column:
    hit, (y, m, d) = _match(c, rf"\A(\d{{4}})-{_MONTH}-{_DAY}\z", 1, 2, 3)
    return F.when(hit, _iso(y, m, d))


def _slash_date(c: Column) -> Column:
    hit, (m, d, y) = _match(c, rf"\A{_MONTH}/{_DAY}/(\d{{4}})\z", 1, 2, 3)
    return F.when(hit, _iso(y, m, d))


def written_date(c: Column) -> Column:
    """``April 3rd, 2025`` / ISO / ``m/d/Y`` / ``3 day of April 2025``; null if none fits."""
    plain = F.regexp_replace(c, ORDINAL_SUFFIX, "$1")
    long_hit, (name, day, year) = _match(plain, rf"\A({_MONTH_NAMES})\s+{_DAY},\s+(\d{{4}})\z", 1, 2, 3)
    of_hit, (day2, name2, year2) = _match(plain, rf"\A{_DAY}\s+day\s+of\s+({_MONTH_NAMES})\s+(\d{{4}})\z", 1, 2, 3)
    return F.coalesce(
        F.when(long_hit, _iso(year, _month_number(name), day)),
        _iso_date(plain),
        _slash_date(plain),
        F.when(of_hit, _iso(year2, _month_number(name2), day2)),
    )


def two_digit_year(yy: Column, as_of_year: int, mode: str = "window") -> Column:
    """Century of a two-digit year.

    ``window`` maps into the hundred years that end ten years after ``as_of_year``.
    ``reference`` keeps the older rule: first 69-99 -> 19xx and 00-68 -> 20xx, then a
    year whose last digits lie beyond the pivot loses a further hundred.
    """
    number = yy.cast("int")
    pivot = as_of_year % 100 + PIVOT_BUFFER
    if mode == "reference":
        read = F.when(number < 69, number + 2000).otherwise(number + 1900)
        return F.when(number > pivot, read - 100).otherwise(read)
    if mode != "window":
        raise ValueError(f"unknown mode {mode!r}")
    last = as_of_year + PIVOT_BUFFER
    return F.lit(last) - F.pmod(F.lit(last) - number, F.lit(100))


def month_year(c: Column, as_of_year: int, mode: str = "window") -> Column:
    """``MM/YY`` or ``MM/YYYY`` as the first of that month; null if neither fits."""
    text = strip(c)
    short, (m, yy) = _match(text, rf"\A{_MONTH}/(\d{{2}})\z", 1, 2)
    full, (m4, y4) = _match(text, rf"\A{_MONTH}/(\d{{4}})\z", 1, 2)
    one = F.lit("1")
    return F.coalesce(
        F.when(short, _iso(two_digit_year(F.when(short, yy), as_of_year, mode), m, one)),
        F.when(full, _iso(y4, m4, one)),
    )


def full_date(c: Column, as_of_year: int, mode: str = "window") -> Column:
    """``m/d/yy``, ``m/d/YYYY`` or ISO; null if none fits."""
    text = strip(c)
    short, (m, d, yy) = _match(text, rf"\A{_MONTH}/{_DAY}/(\d{{2}})\z", 1, 2, 3)
    return F.coalesce(
        F.when(short, _iso(two_digit_year(F.when(short, yy), as_of_year, mode), m, d)),
        _slash_date(text),
        _iso_date(text),
    )


def year_in_text(c: Column) -> Column:
    """The year at the end of a text such as ``105,000 (2007)``; null outside 1901-2099."""
    digits = F.regexp_extract(strip(c), YEAR_AT_END, 1)
    return plausible_year(F.when(F.length(digits) == 4, digits.cast("int")))


def plausible_year(year: Column) -> Column:
    return F.when((year > YEAR_AFTER) & (year < YEAR_BEFORE), year)


def iso_text(c: Column, has_time: bool) -> Column:
    """ISO text of a date or timestamp; microseconds only when there are any."""
    if not has_time:
        return F.date_format(c, "yyyy-MM-dd")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
