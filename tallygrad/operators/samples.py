"""Labelled samples: assembling, splitting a vector, train / validation split, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.random import drawn_vector, row_key, uniform
from ..functions.vectors import masked, vector, without_first
from ..session import shared_path


def assemble(df: DataFrame, label: Column, features: Sequence[Column | str], keep: Sequence[str] = ()) -> DataFrame:
    """(label, features) from scalar columns."""
    return df.select(*keep, label.cast("double").alias("label"), vector(*features).alias("features"))


def split_vector(df: DataFrame, x: str, keep: Sequence[str] = ()) -> DataFrame:
    """(label, features) from one array whose first element is the label."""
    return df.select(*keep, F.get(x, F.lit(0)).alias("label"), without_first(F.col(x)).alias("features"))


def numbered_copies(df: DataFrame, name: str = "copy") -> DataFrame:
    """Add a number from 0 that tells rows alike in all columns apart.

    Which of them gets which number cannot be told, so the result is the same for
    every partitioning. Each task numbers its own copies behind a local sort, and a
    small table adds how many there are in the tasks before; a row that is copied a
    million times never meets one task. The rows are written to the shared folder
    once, so that both steps see the same tasks; the table is left there for lazy readers.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "copies")
    hashed = df.withColumn("_row", row_key(df)).sortWithinPartitions("_row")
    stored = hashed.withColumn("_at", F.monotonically_increasing_id())
    stored.write.parquet(path)
    stored = spark.read.schema(stored.schema).parquet(path).withColumn("_task", F.shiftright("_at", 33))
    groups = stored.groupBy("_row", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row per task that holds a copy.
    tasks = Window.partitionBy("_row")
    before = F.sum("_n").over(tasks.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_all", F.sum("_n").over(tasks)).withColumn("_before", F.coalesce(before, F.lit(0)))
    several = groups.where(F.col("_all") > 1).select("_row", "_task", (F.col("_before") - F.col("_first")).alias("_shift"))
    numbered = stored.join(several, ["_row", "_task"], "left")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("_at") + F.col("_shift"), F.lit(0)).alias(name))


def mark_validation(
    df: DataFrame, fraction: float, seed: int = 0, key: Sequence[str] = (), split_copies: bool = False, draw=None
) -> DataFrame:
    """Add ``is_valid``, true for about ``fraction`` of the rows.

    The draw depends on the key (by default the whole row) and the seed, never
    on partitioning or task retries. Rows with the same key stay together, unless
    ``split_copies`` draws for each of several equal rows apart. ``draw`` (key, copy,
    position, seed) replaces the hash for one integer key column, see
    :func:`..functions.random.lehmer`.
    """
    name = "_" + max(["copy", *df.columns], key=len)  # no column of df
    columns = df.columns
    if split_copies:
        df = numbered_copies(df, name)
    number = F.col(f"`{name}`") if split_copies else F.lit(0)
    if draw is not None:
        if len(key) != 1:
            raise ValueError("a draw of your own needs one integer key column")
        chosen = draw(F.col(key[0]), number, F.lit(0), seed)
    else:
        keys = [F.col(c) for c in key] or [F.xxhash64(*[F.col(f"`{c}`") for c in columns])]
        chosen = uniform(*keys, *([number] if split_copies else []), seed=seed)
    return df.withColumn("is_valid", chosen < F.lit(float(fraction))).select(*[F.col(f"`{c}`") for c in columns], "is_valid")


def _kept(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def input_mask(key: Column, width: Column | int, fraction: float, epoch: int, seed: int = 0, draw=None) -> Column:
    """0/1 vector: an element survives when its draw is at least ``fraction``."""
    return drawn_vector(width, key, F.lit(epoch), seed=seed, then=lambda u: _kept(u >= F.lit(float(fraction))), draw=draw)


def mask_features(
    df: DataFrame, fraction: float, key: Column, epoch: int = 0, seed: int = 0, width: int | None = None
) -> DataFrame:
    """Denoising input: set about ``fraction`` of the feature values to 0; labels stay."""
    mask = input_mask(key, F.size("features") if width is None else width, fraction, epoch, seed)
    return df.withColumn("features", masked(F.col("features"), mask))


def dropout_mask(key: Column, units: int, fraction: float, epoch: int, seed: int = 0, draw=None) -> Column:
    """0/1 vector over all hidden units: a unit works when its draw is above ``fraction``."""
    return drawn_vector(
        units, key, F.lit(epoch), seed=seed + 1, then=lambda u: _kept(u > F.lit(float(fraction))), draw=draw
    )
