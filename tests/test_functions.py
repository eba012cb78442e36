import math

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallygrad.functions import activations as act
from tallygrad.functions.metrics import relative_error
from tallygrad.functions.surfaces import rastrigin, rosenbrock, sphere, xor
from tallygrad.functions.vectors import dot, masked, matvec, to_long, to_wide, with_bias, without_first


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def scalars(*xs):
    return [F.lit(float(x)) for x in xs]


def test_activations(spark):
    assert value(spark, act.sigm(F.lit(0.0))) == 0.5
    assert value(spark, act.sigm(F.lit(1000.0))) == 1.0
    assert value(spark, act.sigm(F.lit(-1000.0))) == 0.0
    one = value(spark, act.tanh_opt(F.lit(1.0)))
    assert one == pytest.approx(0.9999972559224791, abs=1e-15)
    assert value(spark, act.tanh_opt_slope(F.lit(one))) == pytest.approx(0.7554124359024464, abs=1e-14)
    assert value(spark, act.sigm_slope(F.lit(0.25))) == 0.1875


@pytest.mark.parametrize("form", [array, scalars])
def test_surfaces(spark, form):
    def at(f, *xs):
        return value(spark, f(form(*xs)))

    assert [at(rosenbrock, 1, 1, 1), at(rosenbrock, 0, 0), at(rosenbrock, 2, 3)] == [0, 1, 101]
    assert [at(rastrigin, 0, 0), at(rastrigin, 1)] == pytest.approx([0, 1], abs=1e-12)
    assert at(sphere, 1, 2, 2) == 9
    assert [at(xor, 0, 0), at(xor, 0, 1), at(xor, 1, 0), at(xor, 1, 1, 5)] == [0, 1, 1, 0]


def test_vectors(spark):
    x = array(1, 2, 3)
    assert value(spark, with_bias(x)) == [1, 1, 2, 3]
    assert value(spark, without_first(with_bias(x))) == [1, 2, 3]
    assert value(spark, without_first(array(1))) == []
    assert value(spark, dot(x, x)) == 14
    assert value(spark, matvec(F.array(array(1, 0, 0), array(1, 1, 1)), x)) == [1, 6]
    assert value(spark, masked(x, array(1, 0, 1))) == [1, 0, 3]


def test_long_and_wide_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None])], "k int, features array<double>")
    long = to_long(df, ["k"], "features")
    assert long.count() == 4
    assert sorted(to_wide(long, ["k"], 2).collect()) == sorted(df.collect())


def test_wide_vectors_are_put_together_in_slices(spark):
    width = 10_000
    rows = spark.range(3).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(width + 5))).alias("pos"))
    rows = rows.select("k", "pos", (F.col("pos") * 10 + F.col("k")).cast("double").alias("value"))
    some = rows.where("not (k = 1 and pos between 100 and 7000) and not (k = 2 and pos <> 9999)")
    wide = to_wide(some.repartition(5), ["k"], width)
    assert len(plan_of(wide)) < 60_000
    got = {r.k: r.features for r in wide.collect()}
    assert got[0] == [10.0 * i for i in range(width)]
    assert got[1] == [None if 100 <= i <= 7000 else 10.0 * i + 1 for i in range(width)]
    assert got[2] == [None] * 9999 + [99992.0]
    outside = spark.createDataFrame([(1, -3, 1.0), (1, None, 2.0)], "k long, pos int, value double")
    assert to_wide(outside, ["k"], 70).first().features == [None] * 70
    assert to_wide(outside, ["k"], 3).first().features == [None] * 3


def test_relative_error(spark):
    def at(label, prediction):
        return value(spark, relative_error(F.lit(float(label)), F.lit(float(prediction))))

    assert at(2, 1.5) == 0.25
    assert at(0, 1) is None
    assert at(-2, -1) == -0.5
    assert math.isclose(at(4, 5), 0.25)


def test_lehmer_draws(spark):
    """The integer steps by hand, and draws spread evenly enough."""
    from tallygrad.functions.random import lehmer

    def by_hand(key, epoch, position, seed):
        x = key % (2**31 - 1)
        for part in (epoch, position, seed, 1):
            x = (x * 48271 + part + 1) % (2**31 - 1)
        return x / (2**31 - 1)

    rows = spark.range(-5, 3000).select("id", lehmer(F.col("id"), F.lit(2), F.lit(3), 4).alias("u")).collect()
    assert all(r.u == by_hand(r.id, 2, 3, 4) and 0 <= r.u < 1 for r in rows)
    assert abs(sum(r.u for r in rows) / len(rows) - 0.5) < 0.03
