"""Rounding modes of amounts. A cast never rounds; each mode is named where it is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the nearest whole, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def half_up_guarded(x: Column, guard: float = 1e-9) -> Column:
    """As half_up, for products that fall short of a half by a float's error."""
    return F.floor(x + F.lit(0.5 + guard)).cast("long")


def half_away(x: Column, digits: int = 0) -> Column:
    """To the nearest, halves away from zero, as a double."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + F.lit(0.5)) / F.lit(10.0**digits)


def down(x: Column) -> Column:
    return F.floor(x).cast("long")


def net_of(gross: Column, tax: float = 0.1) -> Column:
    return half_up(gross / F.lit(1 + tax))


def cents_half_up(cents: Column, numerator: int, denominator: int) -> Column:
    """cents * numerator / denominator in whole numbers, half up."""
    return F.floor((cents * (2 * numerator) + denominator) / (2 * denominator)).cast("long")


def percent_change(now: Column, before: Column, digits: int = 1) -> Column:
    """Of ``before``, in percent; 0 where that is not positive."""
    return F.when(before > 0, half_away((now - before) * F.lit(100.0) / before, digits)).otherwise(F.lit(0.0))


def per_day(total: Column, days: Column) -> Column:
    return half_up(total / F.greatest(days, F.lit(1)))
