"""Questions to a training-log table (one row per epoch, at most ``epochs`` rows a run).

A run without validation has no ``valid_loss``; its training loss judges then,
as it does in training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def judged_loss() -> Column:
    return F.coalesce("valid_loss", "train_loss")


def best_iteration(log: DataFrame, run: Sequence[str] = (), below: float | None = None) -> DataFrame:
    """The epoch with the smallest loss per run, the first one among equals.

    The loss before training (iteration 0) and rows without any loss do not compete.
    """
    log = log.withColumn("loss", judged_loss()).filter((F.col("iteration") > 0) & F.col("loss").isNotNull())
    if below is not None:
        log = log.filter(F.col("loss") < F.lit(float(below)))
    best = log.groupBy(*run).agg(F.min(F.struct("loss", "iteration", "valid_loss")).alias("b"))
    found = best.filter(F.col("b").isNotNull())  # no row where nothing competes
    return found.select(*run, *(F.col(f"b.{c}").alias(c) for c in ("iteration", "valid_loss", "loss")))


def plateau_runs(log: DataFrame, run: Sequence[str] = (), step: float = 1e-9) -> DataFrame:
    """Add ``flat_epochs``: how many epochs in a row, up to this one, changed the loss by at most ``step``.

    A log of one run has no ``run`` column and is one small window. Where the log
    says that an epoch began with new weights (``restarted``), the count starts
    anew with that epoch, as it does in training.
    """
    order = Window.partitionBy(*run).orderBy("iteration")
    change = F.abs(F.lag(judged_loss()).over(order) - judged_loss())
    flat = F.coalesce(change <= F.lit(step), F.lit(False))
    anew = F.coalesce(F.col("restarted"), F.lit(False)) if "restarted" in log.columns else F.lit(False)
    marked = log.withColumns({"_flat": flat.cast("int"), "_starts": (~flat | anew).cast("int")})
    island = F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = marked.withColumn("_island", island)
    inside = Window.partitionBy(*run, "_island").orderBy("iteration")
    count = F.row_number().over(inside) - 1 + F.first("_flat").over(inside)
    return islands.withColumn("flat_epochs", count).drop("_flat", "_starts", "_island")


def step_times(log: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Add ``step_ms``: time of one epoch, from the cumulative ``elapsed_ms``."""
    before = F.lag("elapsed_ms", 1, 0).over(Window.partitionBy(*run).orderBy("iteration"))
    return log.withColumn("step_ms", F.col("elapsed_ms") - before)
