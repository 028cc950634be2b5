"""Dates of records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted notations, tried in this order (an ambiguous one is month first).
FORMATS = ("yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyyMMdd")


def parse_date(c: Column) -> Column:
    """The date of any accepted notation, that of ISO times as written; null where none fits."""
    text = F.trim(c)
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in FORMATS]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(*tried, iso)


def is_valid_date(c: Column) -> Column:
    """Whether a value is a date; 1970-01-01 is taken for a missing one."""
    return F.coalesce(parse_date(c) != F.lit("1970-01-01").cast("date"), F.lit(False))


def shift_date(c: Column, days: int) -> Column:
    return F.date_format(F.date_add(parse_date(c), days), "yyyy-MM-dd")


def swap_month_day(c: Column, days: int = 0) -> Column:
    return F.date_format(F.date_add(parse_date(c), days), "yyyy-dd-MM")
