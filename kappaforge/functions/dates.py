"""Dates of clinical extracts as Column expressions.

Accepted formats of text dates, in order: day first d/M/yyyy, d-M-yyyy,
d.M.yyyy (or month first), ISO yyyy-MM-dd and yyyy/MM/dd, d MMM yyyy and
d-MMM-yyyy. Anything else is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
_MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy")
_OTHER = ("yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d-MMM-yyyy")


def excel_serial(number: Column) -> Column:
    """Date of a spreadsheet serial number (day 0 is 1899-12-30)."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))


def _tried(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


def parse_date(text: Column) -> Column:
    """Day-first date of the part before the first space; numbers in text are no serials here."""
    return _tried(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), _DAY_FIRST + _OTHER)


def parse_dates(text: Column, dayfirst: bool = True) -> Column:
    """Date of a text with mixed formats, where numbers are spreadsheet serials."""
    t = F.trim(text)
    first, then = (_DAY_FIRST, _MONTH_FIRST) if dayfirst else (_MONTH_FIRST, _DAY_FIRST)
    day = F.coalesce(_tried(t, first + _OTHER + then), _tried(F.split_part(t, F.lit(" "), F.lit(1)), first + _OTHER + then))
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), excel_serial(t.try_cast("double"))).otherwise(day)


def swapped(day: Column) -> Column:
    """The date with day and month exchanged; null where that is no other date."""
    return F.when((F.dayofmonth(day) <= 12) & (F.dayofmonth(day) != F.month(day)), F.make_date(F.year(day), F.dayofmonth(day), F.month(day)))


def candidates(day: Column) -> Column:
    """The date and its swapped form, without nulls."""
    return F.array_compact(F.array(day, swapped(day)))
