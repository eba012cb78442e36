import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallygrad.functions.calendar import days_before_month, days_in_month
from tallygrad.operators.readings import complete_months, daily_use, has_missing, select_meters
from tallygrad.plans.sampling import build_samples, clean_readings

SCHEMA = "id string, bar_code string, date string, month int, total double, fee1 double, fee2 double"


def month_rows(ident, year, month, days, total=lambda i: 10.0 * i, fee1=lambda i: float(i * i), fee2=lambda i: 1.0):
    start = dt.date(year, month, 1)
    return [
        (ident, "b", str(start + dt.timedelta(days=i)), year * 100 + month, total(i), fee1(i), fee2(i))
        for i in range(days)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_calendar(spark):
    months = spark.createDataFrame([(201201,), (201202,), (201212,), (201302,)], "m int")
    got = months.select(days_in_month(F.col("m")), days_before_month(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(31, 0), (29, 31), (31, 335), (28, 31)]


def test_only_complete_months_stay(spark):
    rows = (
        month_rows("whole", 2012, 2, 29)
        + month_rows("short", 2012, 2, 28)
        + month_rows("long", 2012, 2, 29) + month_rows("long", 2012, 2, 1)
        + month_rows("twice", 2012, 4, 29) + month_rows("twice", 2012, 4, 1)
    )
    kept = complete_months(frame(spark, rows)).groupBy("id").agg(F.count("*").alias("n")).collect()
    # Rows are counted, not days: a doubled day may fill a month.
    assert {r.id: r.n for r in kept} == {"whole": 29, "twice": 30}


def test_null_policies(spark):
    rows = month_rows("a", 2012, 2, 29, total=lambda i: None if i == 3 else 10.0 * i) + month_rows("b", 2012, 2, 29)
    readings = frame(spark, rows)
    assert {r.id for r in complete_months(readings).select("id").distinct().collect()} == {"a", "b"}
    assert {r.id for r in complete_months(readings, null_policy="drop").select("id").distinct().collect()} == {"b"}
    assert readings.filter(has_missing()).count() == 1
    with pytest.raises(ValueError):
        complete_months(readings, null_policy="maybe")


def uses(spark, totals):
    rows = [("m", "b", f"2012-01-{i + 1:02d}", 201201, t, t, t) for i, t in enumerate(totals)]
    clean = daily_use(complete_months(frame(spark, rows), expected_rows=len(totals)))
    return [r.total_use for r in clean.orderBy("j").collect()]


def test_first_differences(spark):
    assert uses(spark, [10.0, 12.0, 15.0, 15.0]) == [0, 2, 3, 0]
    assert uses(spark, [None, 5.0, 9.0]) == [0, 5, 4]


def test_order_by_total_or_date(spark):
    rows = month_rows("m", 2012, 2, 29, total=lambda i: 100.0 - i, fee1=lambda i: 1000.0 - 2 * i)
    by_total = clean_readings(frame(spark, rows)).orderBy("j").first()
    by_date = clean_readings(frame(spark, rows), order_by="date").orderBy("j").first()
    assert (by_total.date, by_total.day_of_year) == ("2012-02-29", 31)
    assert (by_date.date, by_date.day_of_year) == ("2012-02-01", 31)
    assert all(r.fee1_use == 2 for r in clean_readings(frame(spark, rows)).filter("j > 0").collect())


def test_neighbours_of_a_28_day_month(spark):
    # fee1 grows so that the use of day j is j.
    rows = month_rows("m", 2013, 2, 28, fee1=lambda i: i * (i + 1) / 2)
    got = {r.j: (r.label, list(r.features)) for r in build_samples(frame(spark, rows)).collect()}
    assert sorted(got) == list(range(1, 28))
    assert got[1] == (1, [2, 3, 4, 5, 6, 7])
    assert got[2] == (2, [3, 4, 5, 6, 7, 8])
    assert got[3] == (3, [0, 1, 2, 4, 5, 6])
    assert got[24] == (24, [21, 22, 23, 25, 26, 27])
    assert got[25] == (25, [24, 23, 22, 21, 20, 19])
    assert got[27] == (27, [26, 25, 24, 23, 22, 21])


def test_differences_add_up_and_samples_count(spark):
    rows = month_rows("a", 2012, 1, 31, fee1=lambda i: i**1.5) + month_rows("b", 2012, 3, 31, fee1=lambda i: 7.0 * i)
    clean = clean_readings(frame(spark, rows))
    for r in clean.groupBy("id").agg(F.sum("fee1_use").alias("s"), F.max("fee1").alias("hi"), F.min("fee1").alias("lo")).collect():
        assert r.s == pytest.approx(r.hi - r.lo)
    assert build_samples(frame(spark, rows)).count() == 60
    assert build_samples(frame(spark, rows), ids="a", max_label=5.0).filter("label >= 5").count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    rows = [r for m in range(1, 13) for r in month_rows("a", 2013, m, 28) + month_rows("b", 2013, m, 30)]
    one = build_samples(frame(spark, rows).repartition(1)).collect()
    many = build_samples(frame(spark, rows).repartition(7, "date")).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_select_meters(spark):
    readings = frame(spark, month_rows("a", 2012, 2, 2) + month_rows("b", 2012, 2, 2) + month_rows("c", 2012, 2, 2))
    assert {r.id for r in select_meters(readings, "a").collect()} == {"a"}
    assert {r.id for r in select_meters(readings, ["a", "c"]).collect()} == {"a", "c"}
    table = spark.createDataFrame([("b",), ("b",), ("x",)], "id string")
    assert [r.id for r in select_meters(readings, table).collect()] == ["b", "b"]


def test_short_months_are_refused(spark):
    with pytest.raises(ValueError):
        build_samples(frame(spark, []), expected_rows=8)


def counted_rows(spark, sizes, expected):
    rows = [(f"g{n}", "b", f"d{i:03}", 201201, float(i), 0.0, 0.0, expected.get(n, 40)) for n in sizes for i in range(n)]
    schema = "id string, bar_code string, date string, month int, total double, fee1 double, fee2 double, wanted int"
    return spark.createDataFrame(rows, schema)


def test_expected_rows_of_a_column(spark):
    """Neither cut nor let in: groups below, at and above their own expectation."""
    rows = counted_rows(spark, (20, 31, 32, 40, 50), {20: 20, 31: 30, 32: 32})
    for at_most in (None, 40, 90):
        whole = complete_months(rows, F.col("wanted"), at_most=at_most)
        got = {r.id: r.n for r in whole.collect()}
        assert got == {"g20": 20, "g32": 32, "g40": 40}
        assert whole.count() == 92
    assert {r.id for r in complete_months(rows, F.lit(40)).collect()} == {"g40"}
    assert {r.id for r in complete_months(rows, F.lit(32)).collect()} == {"g32"}
    assert {r.id for r in complete_months(rows, 50).collect()} == {"g50"}
    with pytest.raises(Exception, match="at_most"):
        complete_months(rows, F.col("wanted"), at_most=39).collect()
    with pytest.raises(ValueError):
        complete_months(rows, 40, at_most=50)


def test_short_months_of_a_column_are_refused(spark):
    rows = counted_rows(spark, (5, 20), {5: 5, 20: 20})
    with pytest.raises(Exception, match="at least"):
        build_samples(rows, expected_rows=F.col("wanted")).collect()
    assert build_samples(rows.where("wanted = 20"), expected_rows=F.col("wanted")).count() == 19


def test_hot_meter_is_cut_before_the_exchange(spark):
    """A broken id with far too many rows never crosses the network as a whole, and changes nothing."""
    good = [r for k in range(20) for r in month_rows(f"m{k}", 2012, 2, 29)]
    hot = spark.range(60000).select(
        F.lit("").alias("id"),
        F.lit("b").alias("bar_code"),
        F.lit("2012-02-01").alias("date"),
        F.lit(201202).alias("month"),
        *[F.col("id").cast("double").alias(c) for c in ("total", "fee1", "fee2")],
    )
    plain, mixed = frame(spark, good), frame(spark, good).unionByName(hot)
    assert sorted(map(str, build_samples(plain).collect())) == sorted(map(str, build_samples(mixed).collect()))
    path = plan_of(build_samples(mixed))
    below = path[path.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below
    assert path.count("Exchange hashpartitioning") == 1


def test_one_exchange_and_one_sort_behind_it(spark):
    text = plan_of(build_samples(frame(spark, month_rows("a", 2012, 2, 29)), "a"))
    assert text.count("Exchange") == 1
    above = text[: text.index("Exchange")]
    assert above.count("Sort [") == 1


def test_known_daily_input_skips_the_map_side_sort(spark):
    rows = month_rows("a", 2012, 2, 29)
    quick = build_samples(frame(spark, rows), cut=False)
    assert "WindowGroupLimit" not in plan_of(quick)
    assert sorted(map(str, quick.collect())) == sorted(map(str, build_samples(frame(spark, rows)).collect()))


def test_long_id_tables_are_joined_behind_the_group_limit(spark):
    rows = month_rows("a", 2012, 2, 29) + month_rows("b", 2012, 2, 29) + month_rows("", 2012, 2, 29) * 3
    readings = frame(spark, rows)
    ids = spark.createDataFrame([("a",), ("a",), ("",), ("x",)], "id string")
    few = build_samples(readings, ids)
    for most in ("100", "-1"):  # bytes; -1 means never
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            many = build_samples(readings, ids)
            plan = plan_of(many)
            found = sorted(map(str, many.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(map(str, few.collect())) == found
    assert few.count() == 28
    # Read from the top: the join comes first, the limits lie below it.
    assert plan.index("LeftSemi") < plan.index("WindowGroupLimit")
    plan = plan_of(build_samples(readings, ids))
    assert plan.index("BroadcastHashJoin") > plan.rindex("WindowGroupLimit")
