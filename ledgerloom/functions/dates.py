"""Month arithmetic of statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end_after(d: Column, months: int | Column) -> Column:
    return F.last_day(F.add_months(d, months))


def shifted(d: Column, months: int = 1) -> Column:
    """The same day of a later month; the last day of a month stays the last."""
    later = F.add_months(d, months)
    return F.when(d == F.last_day(d), F.last_day(later)).otherwise(later)


def excel_serial(n: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def iso_month(text: Column) -> Column:
    """The first day of the month in texts such as 2024年5月, 2024/05, 2024-5-31, 202405; null otherwise."""
    year, month = F.regexp_extract(text, r"(\d{4})\D?(\d{1,2})", 1), F.regexp_extract(text, r"(\d{4})\D?(\d{1,2})", 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01"))).try_cast("date")
