"""Calendar columns for months written as the integer yyyymm."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_start(month: Column) -> Column:
    return F.make_date(F.floor(month / F.lit(100)).cast("int"), (month % F.lit(100)).cast("int"), F.lit(1))


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(month)))


def days_before_month(month: Column) -> Column:
    """Days of the year that lie before the month."""
    return F.dayofyear(month_start(month)) - F.lit(1)


def yyyymm(date: Column) -> Column:
    return F.year(date) * F.lit(100) + F.month(date)
