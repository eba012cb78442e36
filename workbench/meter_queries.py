"""Queries over meter readings: sources, cleaning, windows, samples, sample store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrad.functions.calendar import days_before_month, days_in_month, yyyymm
from tallygrad.operators.neighbours import below, neighbour_samples
from tallygrad.operators.readings import (
    complete_months,
    daily_use,
    has_missing,
    meter_months,
    reading_order,
    zero_filled,
)
from tallygrad.plans.sampling import build_samples, clean_readings
from tallygrad.session import shared_path
from tallygrad.sources.meters import FIELDS, read_meter_csv, typed_records
from tallygrad.sources.results import dump_samples, sample_lines
from tallygrad.sources.samples import SampleStore, parse_sample_text, sample_text

from .fixtures import (
    GAPPY,
    READINGS,
    SAMPLE_COLUMNS,
    SAMPLES,
    clean_sql,
    gappy_readings,
    readings,
    table,
)
from .registry import register

KEYS = ["id", "month", "j"]
FILE_HEADER = [name for name, _ in FIELDS.values()]


def flat(samples: DataFrame) -> DataFrame:
    return sample_lines(samples, 6, KEYS)


def write_monthly_csv(spark: SparkSession, sf_dir: str) -> str:
    """The readings as CSV files, one folder per year and month."""
    path = shared_path(spark, "meter-csv")
    named = readings(spark, sf_dir).withColumnRenamed("bar_code", "barCode").withColumnRenamed("month", "period")
    rows = named.select(*FILE_HEADER, F.substring("date", 1, 4).alias("year"), "period").hint("rebalance", "period")
    rows.write.partitionBy("year", "period").option("header", True).csv(path)
    return path


@register(
    "src1_read_meter_csv",
    f"WITH {READINGS} SELECT id, bar_code, date, total, fee1, fee2, month FROM readings",
)
def read_csv(spark, sf_dir):
    path = write_monthly_csv(spark, sf_dir)
    return read_meter_csv(spark, [path], month_pattern=r"period=(\d{6})")


@register(
    "src2_month_of_file",
    f"WITH {READINGS} SELECT month, count(*) AS n, max(total) AS last_total FROM readings GROUP BY month",
)
def month_of_file(spark, sf_dir):
    path = write_monthly_csv(spark, sf_dir)
    rows = read_meter_csv(spark, [path], month_pattern=r"period=(\d{6})", header=FILE_HEADER)
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("last_total"))


@register(
    "src2_month_by_position",
    f"WITH {READINGS} SELECT id, date, total, month FROM readings",
)
def month_by_position(spark, sf_dir):
    """The files of all years, their months listed next to their paths."""
    path = write_monthly_csv(spark, sf_dir)
    months = [r.month for r in readings(spark, sf_dir).select("month").distinct().orderBy("month").collect()]
    paths = [f"{path}/year={m // 100}/period={m}" for m in months]
    return read_meter_csv(spark, paths, months=months).select("id", "date", "total", "month")


@register(
    "src3_typed_records",
    f"WITH {READINGS}"
    """
    SELECT id, bar_code, date, total, TRY_CAST(CASE WHEN substr(date, 9, 2) = '01' THEN 'n/a' ELSE CAST(fee1 AS VARCHAR)
           END AS DOUBLE) AS fee1, TRY_CAST(concat(CAST(fee2 AS VARCHAR), '') AS DOUBLE) AS fee2 FROM readings""",
)
def typed(spark, sf_dir):
    text = readings(spark, sf_dir).select(
        "id",
        "bar_code",
        "date",
        F.col("total").cast("string").alias("total"),
        F.when(F.substring("date", 9, 2) == "01", "n/a").otherwise(F.col("fee1").cast("string")).alias("fee1"),
        F.col("fee2").cast("string").alias("fee2"),
        F.lit("dropped").alias("other"),
    )
    return typed_records(text, {"bar_code": "bar_code"})


@register(
    "src4_sample_text",
    SAMPLES + "SELECT id, label, x0, x1, x2, x3, x4, x5 FROM samples WHERE label < 1000000",
)
def text_samples(spark, sf_dir):
    path = shared_path(spark, "sample-text")
    samples = build_samples(readings(spark, sf_dir))
    sample_text(samples, ["id"]).write.partitionBy("id").text(path)
    lines = spark.read.schema("value string, id string").text(path)
    return sample_lines(parse_sample_text(lines, max_label=1e6, keep=["id"]), 6, ["id"])


def store_path(spark):
    return shared_path(spark, "sample-store")


@register("snk1_save_samples", SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples")
def save_samples(spark, sf_dir):
    store = SampleStore(spark, store_path(spark), buckets=4)
    samples = build_samples(readings(spark, sf_dir))
    store.save(samples.withColumn("label", F.col("label") + 1))
    store.save(samples)
    return flat(store.read())


@register("snk2_cached_samples", SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples")
def cached_samples(spark, sf_dir):
    source = readings(spark, sf_dir)
    store = SampleStore(spark, store_path(spark), buckets=4)
    ids = source.select("id").distinct()
    warm = ids.filter(F.col("id").startswith("A"))
    store.get_or_build(warm, lambda missing: build_samples(source, missing))
    return flat(store.get_or_build(ids, lambda missing: build_samples(source, missing)))


@register("snk3_dump_samples", SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples")
def dumped_samples(spark, sf_dir):
    path = shared_path(spark, "sample-dump")
    dump_samples(build_samples(readings(spark, sf_dir)), path, 6, KEYS)
    schema = "id string, month int, j int, label double, " + ", ".join(f"x{i} double" for i in range(6))
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@register(
    "fil1_complete_months",
    f"WITH {READINGS},{clean_sql()} SELECT id, month, j, n, total FROM whole",
)
def whole_months(spark, sf_dir):
    return complete_months(readings(spark, sf_dir)).select("id", "month", "j", "n", "total")


PERIODS = (
    READINGS
    + """,
periods AS (
  SELECT id, date, total, fee1, fee2, CAST(date AS DATE) AS dt,
         CASE WHEN id LIKE 'A%' THEN month ELSE CAST(year(CAST(date AS DATE)) * 10 + quarter(CAST(date AS DATE)) AS INTEGER)
         END AS month,
         CAST(CASE WHEN id LIKE 'A%' THEN day(last_day(CAST(date AS DATE)))
              ELSE datediff('day', date_trunc('quarter', CAST(date AS DATE)),
                            date_trunc('quarter', CAST(date AS DATE)) + INTERVAL 3 MONTH) END AS INTEGER) AS expected
  FROM readings)"""
)


@register(
    "fil1_expected_rows_column",
    f"WITH {PERIODS} SELECT id, month, CAST(row_number() OVER (PARTITION BY id, month ORDER BY total, date, fee1, fee2) - 1 AS INTEGER) "
    "AS j, n, total FROM (SELECT *, count(*) OVER (PARTITION BY id, month) AS n FROM periods) WHERE n = expected",
)
def whole_periods(spark, sf_dir):
    """Months of some meters and quarters of others, each held to its own number of days."""
    rows = readings(spark, sf_dir)
    day, monthly = F.to_date("date"), F.col("id").startswith("A")
    quarter = F.date_trunc("quarter", day)
    rows = rows.withColumns(
        {
            "expected": F.when(monthly, F.dayofmonth(F.last_day(day))).otherwise(F.datediff(F.add_months(quarter, 3), quarter)),
            "month": F.when(monthly, F.col("month")).otherwise(F.year(day) * 10 + F.quarter(day)),
        }
    )
    return complete_months(rows, F.col("expected"), at_most=92).select("id", "month", "j", "n", "total")


@register(
    "fil2_missing_test",
    f"WITH {GAPPY} SELECT id, date, (id IS NULL OR total IS NULL OR fee1 IS NULL OR fee2 IS NULL) AS missing FROM gappy",
)
def missing_test(spark, sf_dir):
    return gappy_readings(spark, sf_dir).select("id", "date", has_missing().alias("missing"))


@register(
    "fil3_null_policy_zero",
    f"WITH {GAPPY},{clean_sql('gappy')} SELECT id, month, j, date, total, fee2 FROM whole",
)
def nulls_as_zero(spark, sf_dir):
    return complete_months(gappy_readings(spark, sf_dir)).select("id", "month", "j", "date", "total", "fee2")


@register(
    "fil3_null_policy_drop",
    f"WITH {GAPPY},{clean_sql('gappy', 'drop')} SELECT id, month, j, date, total, fee1 FROM whole",
)
def nulls_dropped(spark, sf_dir):
    kept = complete_months(gappy_readings(spark, sf_dir), null_policy="drop")
    return kept.select("id", "month", "j", "date", "total", "fee1")


@register(
    "fil4_zero_filled",
    f"WITH {GAPPY} SELECT id, date, coalesce(total, 0) AS total, coalesce(fee1, 0) AS fee1, coalesce(fee2, 0) AS fee2 FROM gappy",
)
def filled(spark, sf_dir):
    return zero_filled(gappy_readings(spark, sf_dir)).select("id", "date", "total", "fee1", "fee2")


@register(
    "fil5_select_meters",
    SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples WHERE id IN (SELECT concat(l_returnflag, 'F') FROM lineitem)",
)
def wanted_meters(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit("F")).alias("id")).distinct()
    return flat(build_samples(readings(spark, sf_dir), ids))


@register("fil6_first_day_is_no_target", SAMPLES + "SELECT id, month, j, label FROM samples")
def targets(spark, sf_dir):
    clean = clean_readings(readings(spark, sf_dir))
    return neighbour_samples(clean, order=reading_order()).select("id", "month", "j", "label")


@register(
    "fil7_label_cut",
    SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples WHERE label < 500000",
)
def label_cut(spark, sf_dir):
    return flat(below(build_samples(readings(spark, sf_dir)), 500000.0))


@register(
    "agg1_meter_months",
    f"WITH {READINGS} SELECT id, month, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM readings "
    "GROUP BY id, month",
)
def meter_months_of_readings(spark, sf_dir):
    return meter_months(readings(spark, sf_dir))


@register("win1_rank_by_total", f"WITH {GAPPY},{clean_sql('gappy')} SELECT id, month, j, date, day_of_year FROM clean")
def ranked(spark, sf_dir):
    return clean_readings(gappy_readings(spark, sf_dir)).select("id", "month", "j", "date", "day_of_year")


@register(
    "win2_daily_use",
    f"WITH {GAPPY},{clean_sql('gappy')} SELECT id, month, j, total_use, fee1_use, fee2_use FROM clean",
)
def use(spark, sf_dir):
    clean = daily_use(complete_months(gappy_readings(spark, sf_dir)))
    return clean.select("id", "month", "j", "total_use", "fee1_use", "fee2_use")


@register("win3_neighbour_samples", SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples")
def neighbours(spark, sf_dir):
    return flat(build_samples(readings(spark, sf_dir)))


@register(
    "srt1_order_in_month",
    f"WITH {GAPPY},{clean_sql('gappy')} SELECT id, month, j, total FROM whole",
)
def month_order(spark, sf_dir):
    return complete_months(gappy_readings(spark, sf_dir)).select("id", "month", "j", "total")


@register(
    "set1_months_concatenated",
    SAMPLES + f"SELECT {SAMPLE_COLUMNS} FROM samples",
)
def concatenated(spark, sf_dir):
    """All monthly files as one scan of several paths."""
    path = write_monthly_csv(spark, sf_dir)
    paths = [f"{path}/year=*/period=*{half}" for half in ("[0-4]", "[5-9]")]
    return flat(build_samples(read_meter_csv(spark, paths, month_pattern=r"period=(\d{6})", header=FILE_HEADER)))


@register(
    "sc18_calendar",
    "SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INTEGER) AS month_days, "
    "CAST(dayofyear(date_trunc('month', o_orderdate)) - 1 AS INTEGER) AS days_before FROM orders",
)
def calendar(spark, sf_dir):
    month = yyyymm(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", days_in_month(month).alias("month_days"), days_before_month(month).alias("days_before")
    )
