"""Test tables restated as meter readings and labelled samples, in Spark and in SQL.

Sums are taken over whole cents, so both engines get the same doubles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallygrad.functions.calendar import yyyymm
from tallygrad.functions.vectors import vector
from tallygrad.network import NetworkConfig, Weights


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- meter readings from lineitem -------------------------------------------------

READINGS = """
daily AS (
  SELECT concat(l_returnflag, l_linestatus) AS id, CAST(l_shipdate AS DATE) AS dt,
         sum(CAST(l_quantity AS BIGINT)) AS q,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p,
         sum(CAST(round(l_quantity * l_discount * 100) AS BIGINT)) AS z
  FROM lineitem GROUP BY 1, 2),
readings AS (
  SELECT id, concat('M-', id) AS bar_code, CAST(dt AS VARCHAR) AS date,
         CAST(year(dt) * 100 + month(dt) AS INTEGER) AS month,
         CAST(sum(q) OVER w AS DOUBLE) AS total,
         CAST(sum(p) OVER w AS DOUBLE) / 100 AS fee1,
         CAST(sum(z) OVER w AS DOUBLE) / 100 AS fee2
  FROM daily WINDOW w AS (PARTITION BY id ORDER BY dt))"""

# Missing values: the total on the 10th outside two years, fee2 on the 20th of some months.
GAPPY = (
    READINGS
    + """,
gappy AS (
  SELECT id, bar_code, date, month,
         CASE WHEN substr(date, 9, 2) <> '10' OR substr(date, 1, 4) IN ('1998', '2000') THEN total END AS total, fee1,
         CASE WHEN substr(date, 9, 2) <> '20' OR substr(date, 6, 2) NOT IN ('02', '06', '10') THEN fee2 END AS fee2
  FROM readings)"""
)


def readings(spark: SparkSession, sf_dir: str, meter=None) -> DataFrame:
    """Cumulative daily readings; a meter is a return flag with a line status.

    Lines are summed per meter and day on the map side, so the running sums
    only see one row per meter and calendar day.
    """
    meter = F.concat("l_returnflag", "l_linestatus") if meter is None else meter

    def cents(x):
        return F.sum(F.round(x * 100).cast("long"))

    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(meter.alias("id"), F.col("l_shipdate").cast("date").alias("dt"))
        .agg(
            F.sum(F.col("l_quantity").cast("long")).alias("q"),
            cents(F.col("l_extendedprice")).alias("p"),
            cents(F.col("l_quantity") * F.col("l_discount")).alias("z"),
        )
    )
    w = Window.partitionBy("id").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "id",
        F.concat(F.lit("M-"), "id").alias("bar_code"),
        F.col("dt").cast("string").alias("date"),
        yyyymm(F.col("dt")).alias("month"),
        F.sum("q").over(w).cast("double").alias("total"),
        (F.sum("p").over(w).cast("double") / 100).alias("fee1"),
        (F.sum("z").over(w).cast("double") / 100).alias("fee2"),
    )


def gappy_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month, day = F.substring("date", 1, 4), F.substring("date", 6, 2), F.substring("date", 9, 2)
    return readings(spark, sf_dir).withColumns(
        {
            "total": F.when((day != "10") | year.isin("1998", "2000"), F.col("total")),
            "fee2": F.when((day != "20") | ~month.isin("02", "06", "10"), F.col("fee2")),
        }
    )


def clean_sql(source: str = "readings", null_policy: str = "zero") -> str:
    """CTEs ``clean`` and ``samples`` over a readings CTE."""
    keep = "n = day(last_day(make_date(month // 100, month % 100, 1)))"
    if null_policy == "drop":
        keep += " AND NOT gap"
    neighbours = {
        "ahead": [f"lead(fee1_use, {k}) OVER w" for k in (1, 2, 3, 4, 5, 6)],
        "back": [f"lag(fee1_use, {k}) OVER w" for k in (1, 2, 3, 4, 5, 6)],
        "around": [f"lag(fee1_use, {k}) OVER w" for k in (3, 2, 1)] + [f"lead(fee1_use, {k}) OVER w" for k in (1, 2, 3)],
    }
    xs = ",\n         ".join(
        f"CASE WHEN j < 3 THEN {neighbours['ahead'][i]} WHEN j >= n - 3 THEN {neighbours['back'][i]} "
        f"ELSE {neighbours['around'][i]} END AS x{i}"
        for i in range(6)
    )
    return f"""
flagged AS (
  SELECT *, max(id IS NULL OR total IS NULL OR fee1 IS NULL OR fee2 IS NULL) OVER (PARTITION BY id, month) AS gap
  FROM {source}),
filled AS (
  SELECT id, month, date, gap, coalesce(total, 0) AS total, coalesce(fee1, 0) AS fee1, coalesce(fee2, 0) AS fee2
  FROM flagged),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id, month ORDER BY total, date, fee1, fee2) - 1 AS INTEGER) AS j,
         count(*) OVER (PARTITION BY id, month) AS n
  FROM filled),
whole AS (SELECT * FROM ranked WHERE {keep}),
clean AS (
  SELECT id, month, date, j, n, total, fee1, fee2,
         CAST(dayofyear(make_date(month // 100, month % 100, 1)) - 1 + j AS INTEGER) AS day_of_year,
         coalesce(total - lag(total) OVER w, 0) AS total_use,
         coalesce(fee1 - lag(fee1) OVER w, 0) AS fee1_use,
         coalesce(fee2 - lag(fee2) OVER w, 0) AS fee2_use
  FROM whole WINDOW w AS (PARTITION BY id, month ORDER BY j)),
around AS (
  SELECT id, month, j, fee1_use AS label,
         {xs}
  FROM clean WINDOW w AS (PARTITION BY id, month ORDER BY j)),
samples AS (SELECT * FROM around WHERE j > 0)"""


SAMPLES = f"WITH {READINGS},{clean_sql()}\n"
SAMPLE_COLUMNS = "id, month, j, label, x0, x1, x2, x3, x4, x5"

# --- labelled samples -------------------------------------------------------------

# Line items as regression samples: all values in [0, 1], the last half year is held out.
LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_discount * 10 AS y, l_shipdate >= TIMESTAMP '2001-07-01' AS v,
         l_quantity / 50 AS x1, l_extendedprice / 105000 AS x2, l_tax * 12.5::DOUBLE AS x3,
         l_linenumber / 7.0::DOUBLE AS x4, dayofyear(l_shipdate) / 366.0::DOUBLE AS x5,
         day(l_shipdate) / 31.0::DOUBLE AS x6
  FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).alias("label"),
        vector(
            F.col("l_quantity") / 50,
            F.col("l_extendedprice") / 105000,
            F.col("l_tax") * 12.5,
            F.col("l_linenumber") / 7.0,
            F.dayofyear("l_shipdate") / 366.0,
            F.dayofmonth("l_shipdate") / 31.0,
        ).alias("features"),
        (F.col("l_shipdate") >= F.lit("2001-07-01").cast("timestamp")).alias("is_valid"),
    )


# Embeddings as samples: label / 10, 64 doubles.
EMBEDDED = (
    "embedded AS (SELECT vec_id, label / 10.0::DOUBLE AS y, false AS v, "
    + ", ".join(f"embedding[{i}]::DOUBLE AS x{i}" for i in range(1, 65))
    + " FROM embeddings)"
)
EMBEDDED_LONG = """
long AS (
  SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") / 10.0).alias("label"), F.col("embedding").cast("array<double>").alias("features")
    )


def formula_weights(config: NetworkConfig) -> Weights:
    """Weights both engines can build: cos(r + 2c) / 20."""
    return [
        np.array([[math.cos(r + 2 * c) / 20 for c in range(cols)] for r in range(rows)])
        for rows, cols in config.shapes
    ]
