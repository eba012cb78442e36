"""Feature scaling and label min-max with statistics over all rows.

Statistics are one aggregate with map-side partials. Applying them is a
projection: no row is shuffled and nothing is joined. The fitted numbers are
read lazily through a scalar subquery; streams take them as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.vectors import without_first


def half_variance(x: Column) -> Column:
    """Aggregate: sum of squared deviations over twice the count.

    Merging partial variances of a constant can leave a trace of rounding, which
    as a divisor would blow up; a constant is told by its range instead.
    """
    return F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.var_pop(x) / F.lit(2.0))


def column_stats(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One row ``stats`` (means, spreads, label_min, label_max) over scalar columns."""
    return df.agg(
        F.struct(
            F.array(*[F.avg(c) for c in features]).alias("means"),
            F.array(*[half_variance(F.col(c)) for c in features]).alias("spreads"),
            F.min(label).alias("label_min"),
            F.max(label).alias("label_max"),
        ).alias("stats")
    )


def vector_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """Mean and half variance per position (pos, mean, spread), for any vector width."""
    return (
        df.select(F.posexplode(features).alias("pos", "value"))
        .groupBy("pos")
        .agg(F.avg("value").alias("mean"), half_variance(F.col("value")).alias("spread"))
    )


def label_stats(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.min(label).alias("label_min"), F.max(label).alias("label_max"))


def sample_stats(df: DataFrame) -> DataFrame:
    """One row ``stats`` like :func:`column_stats` for (label, features) samples of any width.

    Label and features are exploded together, so a single pass gives all numbers;
    per task only one small state per position is shuffled. Measured ten times
    faster on 64 features than one aggregate function per feature.
    """
    together = F.concat(F.array("label"), F.col("features"))
    per_pos = (
        df.select(F.posexplode(together).alias("pos", "value"))
        .groupBy("pos")
        .agg(
            F.avg("value").alias("mean"),
            half_variance(F.col("value")).alias("spread"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )
    # One row per position is left, as many as a vector is wide.
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean", "spread", "low", "high")))
    rows = per_pos.agg(ordered.alias("s")).select(F.get("s", F.lit(0)).alias("y"), without_first(F.col("s")).alias("x"))
    return rows.select(
        F.struct(
            F.col("x.mean").alias("means"),
            F.col("x.spread").alias("spreads"),
            F.col("y.low").alias("label_min"),
            F.col("y.high").alias("label_max"),
        ).alias("stats")
    )


def scale(df: DataFrame, stats: DataFrame | Row) -> DataFrame:
    """Scale features to (x - mean) / half variance and the label to [0, 1].

    A constant feature or label gives NULL. ``stats`` is the one-row table of
    :func:`sample_stats`, read lazily as a subquery when the result is, whatever
    the width; or that row, as streams need it.
    """
    name = "_" + max(["stats", *df.columns], key=len)  # no column of df
    if isinstance(stats, DataFrame):
        fitted = stats.select("stats").scalar()
    else:
        row = stats["stats"]
        ends = [F.lit(row[n]).cast("double").alias(n) for n in ("label_min", "label_max")]
        fitted = F.struct(*[F.lit(list(row[n])).cast("array<double>").alias(n) for n in ("means", "spreads")], *ends)
    # Functions over arrays take no subquery, but a column that is one.
    means, spreads, low, high = (F.col(f"`{name}`.{n}") for n in ("means", "spreads", "label_min", "label_max"))
    centred = F.zip_with("features", means, lambda x, m: x - m)
    scaled = {
        "features": F.zip_with(centred, spreads, lambda x, v: F.try_divide(x, v)),
        "label": F.try_divide(F.col("label") - low, high - low),
    }
    return df.withColumn(name, fitted).withColumns(scaled).drop(name)


def scale_columns(df: DataFrame, stats: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """:func:`scale` for features in scalar columns, with the table of :func:`column_stats`, read lazily."""
    s = stats.select("stats").scalar()
    scaled = {
        c: F.try_divide(F.col(c) - F.get(s["means"], F.lit(i)), F.get(s["spreads"], F.lit(i)))
        for i, c in enumerate(features)
    }
    scaled[label] = F.try_divide(F.col(label) - s["label_min"], s["label_max"] - s["label_min"])
    return df.withColumns(scaled)
