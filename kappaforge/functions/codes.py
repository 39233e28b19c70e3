"""Codes and identifiers as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("exact", "category")


def normalise_code(code: Column) -> Column:
    """Upper case, letters A-Z and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(code), "[^A-Z0-9]", ""), F.lit(""))


def normalise_diagnosis_code(code: Column) -> Column:
    """normalise_code(), without the filler X of a three-character category."""
    c = normalise_code(code)
    return F.when(c.rlike("^[A-Z][0-9]{2}X$"), F.substring(c, 1, 3)).otherwise(c)


def split_codes(cell: Column) -> Column:
    """Codes of a cell, split at white space; without empty parts and n/a. Null cells have none."""
    parts = F.split(F.coalesce(cell, F.lit("")), r"(?U)\s+")
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "n/a"))


def truncated(codes: Column, level: str = "category") -> Column:
    """Distinct codes of an array at a level: whole codes or their first three characters."""
    return F.array_distinct(F.transform(codes, lambda x: F.substring(x, 1, 3)) if level == "category" else codes)


def at_level(code: Column, level: str = "category") -> Column:
    return F.substring(code, 1, 3) if level == "category" else code


def _number_text(value: Column) -> Column:
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def norm_id(value: Column) -> Column:
    """Digits without leading zeros; a trailing .0 is dropped first."""
    return F.regexp_replace(F.regexp_replace(_number_text(value), "[^0-9]", ""), "^0+", "")


def alnum_id(value: Column) -> Column:
    """Letters and digits in upper case, zeros kept; a trailing .0 is dropped first."""
    return F.regexp_replace(F.upper(_number_text(value)), "[^0-9A-Z]", "")


def plain_id(value: Column) -> Column:
    """Digits without leading zeros, a trailing .0 read as one more digit."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), "[^0-9]", ""), "^0+", "")


def episode_id(value: Column, day: Column) -> Column:
    """Letters and digits of the identifier, an underscore and the day as yyyyMMdd."""
    return F.concat(F.regexp_replace(_number_text(value), "[^A-Za-z0-9]", ""), F.lit("_"), F.date_format(day, "yyyyMMdd"))


def dotted(code: Column) -> Column:
    """J039 as J03.9; three characters or fewer stay."""
    c = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substr(c, F.lit(4)))).otherwise(c)


def no_code(code: Column) -> Column:
    """True for null and for the words that stand for no code."""
    return F.coalesce(F.lower(code).isin("nan", "na", "none", ""), F.lit(True))


def code_for(qualifier: Column, icd10: Column, opcs4: Column) -> Column:
    """The classification code that belongs to a label's qualifier."""
    q = F.lower(F.trim(qualifier))
    return F.when(q == "diagnoses", icd10).when(q == "procedures", opcs4)
