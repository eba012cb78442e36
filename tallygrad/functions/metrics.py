"""Errors and losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def error(label: Column, prediction: Column) -> Column:
    return label - prediction


def squared_error(label: Column, prediction: Column) -> Column:
    return (label - prediction) * (label - prediction)


def relative_error(label: Column, prediction: Column) -> Column:
    """|label - prediction| / label: signed as the label is, NULL for a zero label."""
    return F.try_divide(F.abs(label - prediction), label)


def half_mean_square(err: Column) -> Column:
    """Aggregate: half the mean of the squared errors, NULL over no rows."""
    return F.avg(err * err) * F.lit(0.5)
