"""From raw readings to neighbour samples, with a read-through store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.neighbours import SHORTEST_MONTH, below, neighbour_samples
from ..operators.readings import complete_months, daily_use, reading_order, select_meters
from ..session import shared_path


def stored_ids(ids: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct wanted ids as a table in the shared folder, and whether Spark broadcasts a table of these bytes.

    The files' true size is what Spark plans the join by; nothing is counted.
    """
    spark, path = ids.sparkSession, shared_path(ids.sparkSession, "wanted-ids")
    ids.select("id").where("id is not null").distinct().write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    # The setting as Spark reads it, units and all.
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return spark.read.schema(ids.select("id").schema).parquet(path), size <= most


def clean_readings(
    records: DataFrame,
    ids: str | Sequence[str] | DataFrame | None = None,
    expected_rows: int | Column | None = None,
    null_policy: str = "zero",
    order_by: str = "total",
    cut: bool = True,
    at_most: int | None = None,
) -> DataFrame:
    """Daily use of complete meter-months, for all meters or the wanted ones.

    Listed ids, and tables of them that Spark broadcasts by its own setting, filter
    the readings where they are scanned. A longer table is joined after the complete
    months are found: joining before would move all readings of a broken id, which
    may hold a third of them, into one task. A table of ids is written to the
    shared folder first, so that its size is known. A NULL id asks for nothing.
    """

    def clean(df: DataFrame) -> DataFrame:
        return complete_months(df, expected_rows, null_policy, order_by, cut, at_most)

    if isinstance(ids, DataFrame):
        wanted, in_front = stored_ids(ids)
        whole = clean(select_meters(records, wanted)) if in_front else select_meters(clean(records), wanted)
    else:
        whole = clean(records if ids is None else select_meters(records, ids))
    return daily_use(whole, order_by)


def build_samples(
    records: DataFrame,
    ids: str | Sequence[str] | DataFrame | None = None,
    value: str = "fee1_use",
    expected_rows: int | Column | None = None,
    null_policy: str = "zero",
    order_by: str = "total",
    max_label: float | None = None,
    cut: bool = True,
    at_most: int | None = None,
) -> DataFrame:
    """Neighbour samples of complete meter-months: one exchange for the whole chain.

    A complete meter-month too short for neighbours is an error, never a sample
    with missing features.
    """
    if isinstance(expected_rows, int) and expected_rows < SHORTEST_MONTH:
        raise ValueError(f"neighbour samples need at least {SHORTEST_MONTH} rows in a meter-month")
    clean = clean_readings(records, ids, expected_rows, null_policy, order_by, cut, at_most)
    if isinstance(expected_rows, Column):
        too_short = F.raise_error(F.lit(f"neighbour samples need at least {SHORTEST_MONTH} rows in a meter-month"))
        clean = clean.filter(F.when(F.col("n") >= SHORTEST_MONTH, F.lit(True)).otherwise(too_short))
    return below(neighbour_samples(clean, value, reading_order(order_by)), max_label)
