"""Bounded samples of tables of any size, drawn by a hash of their keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Values of the hash that is compared.
HASHES = 1 << 63
#: Rows that are drawn for each one wanted, since their number varies.
SPARE = 1.2


def bound(there: int, rows: int) -> int:
    """The hashes below which about ``SPARE * rows`` of ``there`` rows lie; all of them where there are no more."""
    return HASHES if there <= rows else min(HASHES, int(SPARE * rows * HASHES) // there)


def drawn(there: int | Column, rows: int, *keys: Column | str) -> Column:
    """True for about as many of ``there`` rows as are wanted; the smallest hashes, so a limit in that order cuts the rest.

    63 bits are compared, so the rate holds for any table that fits a cluster.
    ``there`` may be a column, such as the count of the row's group.
    """
    value = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    if isinstance(there, Column):
        share = F.lit(float(SPARE * rows)) / there
        return (there <= rows) | (value.cast("double") < share * float(HASHES))
    most = bound(there, rows)
    return F.lit(True) if most == HASHES else value < F.lit(most)


def drawn_order(*keys: Column | str) -> Column:
    """The order in which rows were drawn."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1)


def not_empty(rows: list, there: int, what: str) -> list:
    """The drawn rows; none of a table that has some is an error, not a model of nothing."""
    if there and not rows:
        raise RuntimeError(f"no row was drawn from {there} {what}")
    return rows
