"""Vectors as ARRAY<DOUBLE> columns, and the wide <-> long reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def vector(*cols: Column | str) -> Column:
    """ARRAY<DOUBLE> of the given numeric columns."""
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols])


def with_bias(x: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), x)


def without_first(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda u, v: u * v)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def matvec(rows: Column, x: Column) -> Column:
    """Matrix (ARRAY of row arrays) times vector."""
    return F.transform(rows, lambda row: dot(row, x))


def masked(x: Column, mask: Column) -> Column:
    """Element product with a 0/1 or fractional mask."""
    return F.zip_with(x, mask, lambda v, m: v * m)


def to_long(df: DataFrame, keys: Sequence[str], x: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per vector element, positions counted from 0."""
    return df.select(*keys, F.posexplode(x).alias(pos, value))


#: Positions that are aggregated side by side.
SLOTS = 64


def _slots(pos: Column, value: str, width: int) -> list[Column]:
    return [F.max(F.when(pos == i, F.col(value))) for i in range(width)]


def to_wide(
    df: DataFrame, keys: Sequence[str], width: int, x: str = "features", pos: str = "pos", value: str = "value"
) -> DataFrame:
    """Inverse of :func:`to_long`.

    One ``max`` per position instead of ``collect_list``: the state per key has
    a fixed size and is combined before the shuffle, however often a key occurs.
    Wider vectors are put together in two steps, slices of SLOTS positions and
    then the slices, so the plan does not grow with the width. Positions outside
    the width are left out, missing ones are NULL.
    """
    if width <= SLOTS:
        return df.groupBy(*keys).agg(F.array(*_slots(F.col(pos), value, width)).alias(x))
    number = F.floor(F.col(pos) / SLOTS).cast("int")
    parts = df.withColumn("_slice", number).groupBy(*keys, "_slice")
    parts = parts.agg(F.array(*_slots(F.pmod(F.col(pos), F.lit(SLOTS)), value, SLOTS)).alias("_part"))
    last = -(-width // SLOTS) - 1
    # A key has one row per slice by now; slices without any value stay missing.
    here = F.when(F.col("_slice").between(0, last), F.struct("_slice", "_part"))
    by_number = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(here)).alias("_parts"))
    nothing = F.array_repeat(F.lit(None), SLOTS)
    joined = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.coalesce(F.try_element_at("_parts", i), nothing))
    return by_number.select(*keys, F.slice(F.flatten(joined), 1, width).alias(x))
