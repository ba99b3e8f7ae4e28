"""Numeric text and exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two number dialects of the evaluation scripts.
GROUPED_NUMBER = r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?|[-+]?\d+(?:\.\d+)?"
LOOSE_NUMBER = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)"


def money(x: Column) -> Column:
    """Two-decimal value as an exact decimal, so that sums do not depend on row order."""
    return x.cast("decimal(18,2)")


def exact_sum(x: Column) -> Column:
    return F.sum(money(x)).cast("double")


def exact_avg(x: Column) -> Column:
    return F.sum(money(x)).cast("double") / F.count(x)


def plain(x: Column, digits: int = 6) -> Column:
    """A rounded number in positional notation, without trailing zeros but at least one decimal."""
    text = F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def sql_plain(x: str, digits: int = 6) -> str:
    text = f"CAST(CAST(round({x}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR)"
    return f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '.0')"


def as_number(text: Column) -> Column:
    """Text to number after removing thousands separators; NULL when it is not one."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def is_numeric_text(text: Column) -> Column:
    return as_number(text).isNotNull()


def first_number(text: Column, dialect: str = GROUPED_NUMBER) -> Column:
    """First signed number in a text."""
    found = F.regexp_extract(text, f"({dialect})", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def decimals_in(text: Column) -> Column:
    """Digits behind the first dot of a number in text form."""
    return F.when(F.instr(text, ".") > 0, F.length(F.element_at(F.split(text, r"\."), 2))).otherwise(F.lit(0))
