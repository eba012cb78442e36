"""Cumulative meter readings -> daily use of complete meter-months.

All steps are windows over one (id, month) partitioning and one order, so a
whole chain costs a single exchange and a single sort behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.calendar import days_before_month, days_in_month

METER_MONTH = ("id", "month")
COUNTERS = ("total", "fee1", "fee2")
LONGEST_MONTH = 31


def select_meters(df: DataFrame, ids: str | Sequence[str] | DataFrame) -> DataFrame:
    """Keep one meter, a few listed ones, or those of a table with only an ``id`` column."""
    if isinstance(ids, DataFrame):
        return df.join(ids, "id", "left_semi")
    wanted = [ids] if isinstance(ids, str) else list(ids)
    return df.filter(F.col("id").isin(wanted))


def has_missing() -> Column:
    """True when the id or any counter of a reading is missing."""
    test = F.col("id").isNull()
    for c in COUNTERS:
        test = test | F.col(c).isNull()
    return test


def zero_filled(df: DataFrame) -> DataFrame:
    """Read a missing counter as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in COUNTERS})


def meter_months(df: DataFrame) -> DataFrame:
    """(id, month, n, first_date, last_date) of every meter-month."""
    dates = [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    return df.groupBy(*METER_MONTH).agg(F.count(F.lit(1)).alias("n"), *dates)


def reading_order(order_by: str = "total") -> WindowSpec:
    """Order of the readings in a meter-month.

    By ``total`` or by ``date``; the other fields break ties, so the order, and
    with it every result, is fixed up to rows alike in all fields. It names
    plain columns only: windows sharing it then share one sort.
    """
    if order_by not in ("total", "date"):
        raise ValueError("order_by must be 'total' or 'date'")
    first = ("total", "date") if order_by == "total" else ("date", "total")
    return Window.partitionBy(*METER_MONTH).orderBy(*first, "fee1", "fee2")


def complete_months(
    df: DataFrame,
    expected_rows: int | Column | None = None,
    null_policy: str = "zero",
    order_by: str = "total",
    cut: bool = True,
    at_most: int | None = None,
) -> DataFrame:
    """Keep meter-months with as many rows as the calendar month has days.

    Missing counters become 0; ``null_policy="drop"`` drops meter-months that
    hold one. Adds ``j``, the 0-based rank in the meter-month, and ``n``, its row
    count. ``expected_rows`` replaces the calendar: one number for all, or a
    column that is the same for all rows of a meter-month.

    A meter-month with more rows than can be expected is dropped whatever else
    it holds, so its rows past one more than that decide nothing, and filtering
    on the rank lets Spark cut every group *before* the exchange
    (WindowGroupLimit): a broken id holding a third of all readings never
    reaches one task as a whole. The bound follows from the expectation: 31 for
    the calendar, the number itself, and for a column ``at_most``, where a row
    that expects more is an error; a column without it is not cut. The price is
    a sort on the map side; ``cut=False`` skips it, for input known to have one
    row per meter and day.
    """
    if null_policy not in ("zero", "drop"):
        raise ValueError("null_policy must be 'zero' or 'drop'")
    if at_most is not None and not isinstance(expected_rows, Column):
        raise ValueError("at_most goes with a column of expected rows")
    if expected_rows is None:
        expected, bound = days_in_month(F.col("month")), LONGEST_MONTH
    elif isinstance(expected_rows, int):
        expected, bound = F.lit(expected_rows), expected_rows
    else:
        expected, bound = expected_rows, at_most
        if at_most is not None:
            too_many = F.raise_error(F.lit(f"a meter-month expects more than at_most={at_most} rows"))
            expected = F.when(expected > at_most, too_many).otherwise(expected)
    group = Window.partitionBy(*METER_MONTH)
    flagged = df.withColumn("_missing", has_missing()) if null_policy == "drop" else df
    ranked = zero_filled(flagged).withColumn("_rank", F.row_number().over(reading_order(order_by)))
    if cut and bound is not None:
        ranked = ranked.filter(F.col("_rank") <= bound + 1)
    counted = ranked.withColumn("n", F.count(F.lit(1)).over(group))
    keep = F.col("n") == expected
    if null_policy == "drop":
        counted = counted.withColumn("_missing", F.max("_missing").over(group))
        keep = keep & ~F.col("_missing")
    return counted.filter(keep).withColumn("j", F.col("_rank") - 1).drop("_rank", "_missing")


def daily_use(df: DataFrame, order_by: str = "total") -> DataFrame:
    """First differences of the counters inside a meter-month; the first day gets 0.

    Expects the columns of :func:`complete_months` and adds ``day_of_year``
    (0-based), ``total_use``, ``fee1_use`` and ``fee2_use``.
    """
    order = reading_order(order_by)
    uses = {f"{c}_use": F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0)) for c in COUNTERS}
    return df.withColumns({"day_of_year": days_before_month(F.col("month")) + F.col("j"), **uses})
