"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from tallygrad.session import shared_path, ship_package

#: Rows of the Arrow batches between Spark and Python; texts are long, so Spark's default would hold tens of MB.
BATCH_ROWS, BATCH_BYTES = "1000", "8m"
_ROWS_SETTING, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make a session ready for the operators: the package on its workers, and small Arrow batches unless set otherwise.

    Results are lazy, so the settings stay; rows bound batches of short texts and bytes those of long ones.
    """
    ship_package(spark)
    if spark.conf.get(_ROWS_SETTING, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS_SETTING, BATCH_ROWS)
    if spark.conf.get(_BYTES_SETTING, None) is None:
        spark.conf.set(_BYTES_SETTING, BATCH_BYTES)


def kept(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The new plan starts at the files, so a lost executor repeats nothing that
    came before and the rows are the same for every reader. Spark deletes the
    shuffle files of a finished query when the driver collects its garbage;
    ``release`` asks for that, so that large steps do not add up on disk.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        gc.collect()  # Python's handles keep Java's objects
        for _ in range(2):  # what the first round frees may hold others
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)
