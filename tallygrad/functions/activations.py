"""Activation functions and their slopes, as column expressions.

Slopes take the *activation*, not the weighted input, as back-propagation
already holds the former.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the scaled hyperbolic tangent.
TANH_SCALE = 1.7159
TANH_RATE = 2.0 / 3.0


def sigm(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigm_slope(a: Column) -> Column:
    return a * (F.lit(1.0) - a)


def tanh_opt(x: Column) -> Column:
    return F.lit(TANH_SCALE) * F.tanh(x * F.lit(TANH_RATE))


def tanh_opt_slope(a: Column) -> Column:
    return F.lit(TANH_SCALE * TANH_RATE) * (F.lit(1.0) - a * a * F.lit(1.0 / TANH_SCALE**2))


def linear(x: Column) -> Column:
    return x


def linear_slope(a: Column) -> Column:
    return F.lit(1.0)


ACTIVATIONS = {"sigm": sigm, "tanh_opt": tanh_opt, "linear": linear}
SLOPES = {"sigm": sigm_slope, "tanh_opt": tanh_opt_slope, "linear": linear_slope}
