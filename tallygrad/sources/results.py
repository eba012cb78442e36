"""Result tables: predictions, training logs, weights, dumps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.metrics import relative_error
from ..network import WEIGHTS_SCHEMA, NetworkConfig, Weights, weights_from_table, weights_table
from ..session import remove_path


def prediction_report(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(label, prediction, rel_error) of scored rows."""
    return scored.select(
        *keep,
        "label",
        F.col("predict_label").alias("prediction"),
        relative_error(F.col("label"), F.col("predict_label")).alias("rel_error"),
    )


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Rows of one run in a table of many runs, a folder ``run=...`` each.

    Writing a run again replaces its rows and no others, so a step that is
    repeated after a failure leaves nothing twice; an empty result empties the run.
    Spark stages the files and moves them when all tasks are done.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError("a run id may hold letters, digits, dots, dashes and underscores")
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    if not seen.get["n"]:
        remove_path(df.sparkSession, f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs below ``path``: the columns of ``schema`` and ``run``, a string whatever the ids look like."""
    return spark.read.schema(f"{schema}, run string").parquet(path)


def append_predictions(scored: DataFrame, path: str, keep: Sequence[str] = (), run: str | None = None) -> None:
    """Append a report of scored rows; with a ``run`` a repeat takes the place of the first, see :func:`write_run`."""
    report = prediction_report(scored, keep)
    if run is None:
        report.write.mode("append").parquet(path)
    else:
        write_run(report, path, run)


def append_log(log: DataFrame, path: str, run: str | Column | None = None) -> None:
    """Append a training log.

    A ``run`` that is text tells runs in one table apart and makes a repeat
    replace the rows written before; a column is added to the rows as it is.
    """
    if isinstance(run, str):
        write_run(log.coalesce(1), path, run)
        return
    log = log if run is None else log.withColumn("run", run)
    log.coalesce(1).write.mode("append").parquet(path)


def sample_lines(df: DataFrame, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """Samples flattened to columns (label, x0, x1, …)."""
    return df.select(*keep, "label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(width)])


def dump_samples(df: DataFrame, path: str, width: int, keep: Sequence[str] = (), separator: str = "\t") -> None:
    """Samples as text, one line each."""
    sample_lines(df, width, keep).write.mode("append").option("sep", separator).option("header", True).csv(path)


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    weights_table(spark, weights).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, config: NetworkConfig) -> Weights:
    return weights_from_table(spark.read.schema(WEIGHTS_SCHEMA).parquet(path), config)
