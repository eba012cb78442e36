"""Sliding-neighbour samples: one day's use with six days around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from .readings import reading_order

NEIGHBOURS = 6
SHORTEST_MONTH = 9


def neighbour_features(value: str, order: WindowSpec) -> Column:
    """Six neighbours of position ``j`` in a group of ``n`` rows.

    The first two targets look six days ahead, the last three six days back
    (nearest first), all others three days to each side.
    """
    x = F.col(value)
    back = {k: F.lag(x, k).over(order) for k in range(1, NEIGHBOURS + 1)}
    ahead = {k: F.lead(x, k).over(order) for k in range(1, NEIGHBOURS + 1)}
    six = range(1, NEIGHBOURS + 1)
    return (
        F.when(F.col("j") < 3, F.array(*[ahead[k] for k in six]))
        .when(F.col("j") >= F.col("n") - 3, F.array(*[back[k] for k in six]))
        .otherwise(F.array(back[3], back[2], back[1], ahead[1], ahead[2], ahead[3]))
    )


def neighbour_samples(df: DataFrame, value: str = "fee1_use", order: WindowSpec | None = None) -> DataFrame:
    """Samples (id, month, j, label, features) of daily use.

    The first day of a month is no target, as its use is the placeholder 0, but
    it stays a neighbour. ``order`` must rank rows as ``j`` does; passing the
    order of the step before spares a second sort.
    """
    features = neighbour_features(value, order or reading_order())
    return (
        df.withColumn("features", features)
        .filter(F.col("j") > 0)
        .select("id", "month", "j", F.col(value).alias("label"), "features")
    )


def below(df: DataFrame, max_label: float | None) -> DataFrame:
    """Outlier cut: keep samples with a label below ``max_label``; None keeps all."""
    return df if max_label is None else df.filter(F.col("label") < F.lit(float(max_label)))
