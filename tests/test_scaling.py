import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallygrad.operators.scaling import column_stats, label_stats, sample_stats, scale, scale_columns, vector_stats


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(4)
    rows = [(r.uniform(5, 9), [r.gauss(100, 3), r.random(), 7.0]) for _ in range(400)]
    return spark.createDataFrame(rows, "label double, features array<double>"), rows


def test_hand_worked(spark):
    df = spark.createDataFrame([(10.0 * i, [float(i), 3.0]) for i in (1, 2, 3, 4)], "label double, features array<double>")
    got = scale(df, sample_stats(df)).orderBy("label").collect()
    assert [r.features[0] for r in got] == pytest.approx([-2.4, -0.8, 0.8, 2.4])
    assert [r.features[1] for r in got] == [None] * 4
    assert [r.label for r in got] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    flat = df.withColumn("label", F.lit(5.0))
    assert {r.label for r in scale(flat, sample_stats(flat)).collect()} == {None}


def test_statistics_against_numpy(samples):
    df, rows = samples
    x = np.array([f for _, f in rows])
    stats = sample_stats(df).first().stats
    assert np.allclose(stats.means, x.mean(axis=0))
    assert np.allclose(stats.spreads, ((x - x.mean(axis=0)) ** 2).sum(axis=0) / (2 * len(x)))
    assert (stats.label_min, stats.label_max) == (min(l for l, _ in rows), max(l for l, _ in rows))
    by_pos = {r.pos: r for r in vector_stats(df).collect()}
    assert [by_pos[i].mean for i in range(3)] == pytest.approx(stats.means)
    assert tuple(label_stats(df).first()) == (stats.label_min, stats.label_max)


def test_scaled_values_are_centred_and_labels_lie_in_range(samples):
    df, _ = samples
    scaled = scale(df, sample_stats(df))
    means = vector_stats(scaled).filter("pos < 2").collect()
    assert all(abs(m["mean"]) < 1e-10 for m in means)
    low, high = scaled.agg(F.min("label"), F.max("label")).first()
    assert (low, high) == (0.0, 1.0)


def test_scalar_columns_agree_with_vectors(samples):
    df, _ = samples
    wide = df.select("label", *[F.get("features", F.lit(i)).alias(f"c{i}") for i in range(3)])
    names = ["c0", "c1", "c2"]
    a = scale_columns(wide, column_stats(wide, names), names).select("label", F.array(*names).alias("features"))
    b = scale(df, sample_stats(df))
    close = zip(a.orderBy("label").collect(), b.orderBy("label").collect())
    for u, v in close:
        assert u.label == pytest.approx(v.label)
        assert u.features[:2] == pytest.approx(v.features[:2]) and u.features[2] is v.features[2] is None


def test_applying_statistics_neither_shuffles_nor_joins(samples):
    df, _ = samples
    assert "Exchange" not in plan_of(scale(df, sample_stats(df).first()))
    wide = df.select("label", F.get("features", F.lit(0)).alias("c0"))
    plan = plan_of(scale_columns(wide, column_stats(wide, ["c0"]), ["c0"]))
    assert "Join" not in plan


def test_statistics_are_read_with_the_result(spark, samples):
    df, _ = samples
    sizes = []
    for width in (3, 3000):
        wide = spark.range(4).select(
            F.col("id").cast("double").alias("label"),
            F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i * F.col("id")).cast("double")).alias("features"),
        )
        calls = spark.sparkContext.statusTracker().getJobIdsForGroup()
        scaled = scale(wide, sample_stats(wide))
        assert calls == spark.sparkContext.statusTracker().getJobIdsForGroup()
        sizes.append(len(plan_of(scaled)))
        first = scaled.orderBy("label").first()
        assert len(first.features) == width and first.features[-1] == pytest.approx(first.features[0] / width)
    assert abs(sizes[0] - sizes[1]) < 100
    lazily, fitted = scale(df, sample_stats(df)), scale(df, sample_stats(df).first())
    pairs = zip(lazily.orderBy("label").collect(), fitted.orderBy("label").collect())
    assert all(a.features == b.features and a.label == b.label for a, b in pairs)


def test_constants_have_no_spread_however_rows_are_spread(spark):
    for parts in (1, 3, 7):
        df = spark.range(0, 997, 1, parts).select(F.lit(0.1).alias("label"), F.array(F.lit(7.3)).alias("features"))
        assert sample_stats(df).first().stats.spreads == [0.0]
        assert scale(df, sample_stats(df)).filter("label is not null or features[0] is not null").count() == 0
        wide = df.select("label", F.get("features", F.lit(0)).alias("c0"))
        assert column_stats(wide, ["c0"]).first().stats.spreads == [0.0]


def test_one_row_and_no_row(spark):
    schema = "label double, features array<double>"
    one = spark.createDataFrame([(1.0, [2.0])], schema)
    row = scale(one, sample_stats(one)).first()
    assert (row.label, row.features) == (None, [None])
    none = one.filter("label > 5")
    stats = column_stats(none.select("label", F.get("features", F.lit(0)).alias("c0")), ["c0"]).first().stats
    assert stats.label_min is None and stats.means == [None]
