"""Synthetic labelled samples with a known surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.random import uniform
from ..functions.surfaces import SURFACES


def random_samples(
    df: DataFrame, key: Column, width: int, low: float, high: float, surface: str, seed: int = 0
) -> DataFrame:
    """One random sample per row of ``df``: adds ``label`` and ``features``.

    Features are uniform in [low, high), or random bits for ``xor``; they depend on
    the key and the seed only, so a retried task draws the same sample.
    """
    if surface not in SURFACES:
        raise ValueError(f"unknown surface {surface!r}")
    if surface in ("xor", "rosenbrock") and width < 2:
        raise ValueError(f"{surface} needs at least two features")
    draws = [uniform(key, F.lit(i), seed=seed) for i in range(width)]
    if surface == "xor":
        values = [F.when(u > F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0)) for u in draws]
    else:
        values = [u * F.lit(float(high - low)) + F.lit(float(low)) for u in draws]
    kept = [F.col(f"`{c}`") for c in df.columns]
    names = [f"_x{i}" for i in range(width)]
    drawn = df.select(*kept, *[v.alias(n) for v, n in zip(values, names)])
    xs = [F.col(n) for n in names]
    return drawn.select(*kept, SURFACES[surface](xs).alias("label"), F.array(*xs).alias("features"))


def synthetic_samples(
    spark: SparkSession, rows: int, width: int, low: float, high: float, surface: str, seed: int = 0
) -> DataFrame:
    """``rows`` random samples (row_id, label, features)."""
    ids = spark.range(rows).withColumnRenamed("id", "row_id")
    return random_samples(ids, F.col("row_id"), width, low, high, surface, seed)
