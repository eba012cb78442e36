"""Test functions that give synthetic samples a known label.

Each takes either one ARRAY<DOUBLE> column or a list of scalar columns. The
list form unrolls into plain arithmetic, which whole-stage codegen compiles;
the array form works for any width.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

Vector = Column | Sequence[Column]


def _add_up(x: Vector, term) -> Column:
    if isinstance(x, Column):
        return F.aggregate(x, F.lit(0.0), lambda total, v: total + term(v))
    return reduce(lambda a, b: a + b, [term(v) for v in x])


def sphere(x: Vector) -> Column:
    return _add_up(x, lambda v: v * v)


def rastrigin(x: Vector) -> Column:
    return _add_up(x, lambda v: v * v - F.lit(10.0) * F.cos(v * F.lit(2.0 * math.pi)) + F.lit(10.0))


def rosenbrock(x: Vector) -> Column:
    def term(here: Column, after: Column) -> Column:
        bend = after - here * here
        return F.lit(100.0) * bend * bend + (here - F.lit(1.0)) * (here - F.lit(1.0))

    if isinstance(x, Column):
        head = F.slice(x, F.lit(1), F.size(x) - 1)
        tail = F.slice(x, F.lit(2), F.size(x) - 1)
        return F.aggregate(F.zip_with(head, tail, term), F.lit(0.0), lambda total, v: total + v)
    return reduce(lambda a, b: a + b, [term(a, b) for a, b in zip(x, x[1:])])


def xor(x: Vector) -> Column:
    """0 when the first two elements are equal, else 1; further ones are ignored."""
    first, second = (F.get(x, F.lit(0)), F.get(x, F.lit(1))) if isinstance(x, Column) else (x[0], x[1])
    return F.when(first == second, F.lit(0.0)).otherwise(F.lit(1.0))


SURFACES = {"rosenbrock": rosenbrock, "rastrigin": rastrigin, "sphere": sphere, "xor": xor}
