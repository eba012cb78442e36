"""Headline timings on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, functions as F

from tallygrad.network import NetworkConfig
from tallygrad.operators.gradcheck import gradient_check_summary
from tallygrad.operators.gradient import Noise, run_pass
from tallygrad.operators.scaling import sample_stats, scale
from tallygrad.plans.sampling import build_samples
from tallygrad.plans.training import Model, prepare, train
from tallygrad.session import local_session, ship_package
from tallygrad.sources.synthetic import synthetic_samples
from workbench.fixtures import embedded, formula_weights, lines, readings

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
MEMORY = "16g"
# Meters of the made readings, one reading a day for a leap year each, and copies of each embedding to score.
METERS, COPIES = int(os.environ.get("BENCH_METERS", "27500")), 200


def drain(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def made_readings(spark, meters: int) -> DataFrame:
    """Complete daily readings of one year with rising counters."""
    day = (F.col("id") % 366).cast("int")
    meter = F.floor(F.col("id") / 366)
    date = F.date_add(F.lit("2012-01-01").cast("date"), day)

    def counter(seed: int):
        return day * 2.0 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100)) / 100

    return spark.range(meters * 366).select(
        meter.cast("string").alias("id"),
        F.lit("b").alias("bar_code"),
        date.cast("string").alias("date"),
        (F.year(date) * 100 + F.month(date)).alias("month"),
        *(counter(i).alias(c) for i, c in enumerate(("total", "fee1", "fee2"))),
    )


def main() -> None:
    spark = local_session("bench", CPUS, MEMORY)
    ship_package(spark)
    times: dict[str, float] = {}
    rates: dict[str, int] = {}

    def timed(name: str, job, rows: int | None = None):
        started = time.monotonic()
        result = job()
        times[name] = round(time.monotonic() - started, 3)
        if rows:
            rates[name] = int(rows / times[name])
        return result

    samples = lines(spark, SF_DIR)
    total = timed("count_lines", samples.count)
    small = NetworkConfig(size=(6, 5, 1), learning_rate=0.05, momentum=0.0)
    wide = NetworkConfig(size=(64, 5, 1))
    weights = formula_weights(small)

    timed("build_samples", lambda: drain(build_samples(readings(spark, SF_DIR))), total)
    timed("build_samples_again", lambda: drain(build_samples(readings(spark, SF_DIR))), total)
    timed("samples_of_made_readings", lambda: drain(build_samples(made_readings(spark, METERS))), METERS * 366)
    timed("fit_scaler", lambda: sample_stats(samples).first(), total)
    stats = sample_stats(samples).first()
    timed("scale", lambda: drain(scale(samples, stats)), total)

    table = prepare(samples, small, partitions=CPUS)
    timed("first_pass", lambda: run_pass(table, weights, small))
    timed("second_pass", lambda: run_pass(table, weights, small), total)
    timed("third_pass", lambda: run_pass(table, weights, small), total)
    timed("loss_only_pass", lambda: run_pass(table, weights, small, gradient=False), total)
    table.unpersist()
    noisy = NetworkConfig(size=(6, 5, 1), learning_rate=0.05, dropout=0.2, input_mask=0.1)
    keyed = prepare(samples, noisy, partitions=CPUS, key=["l_orderkey", "l_linenumber"])
    run_pass(keyed, weights, noisy, noise=Noise(0))
    timed("noisy_pass", lambda: run_pass(keyed, weights, noisy, noise=Noise(1)), total)
    keyed.unpersist()
    timed("train_20_epochs", lambda: train(samples, small, 20, init_weights=weights, partitions=CPUS), total * 20)
    timed(
        "train_5_epochs_noisy",
        lambda: train(
            samples, noisy, 5, init_weights=weights, partitions=CPUS, key=["l_orderkey", "l_linenumber"]
        ),
        total * 5,
    )
    manual = synthetic_samples(spark, 29500, 6, -10.0, 10.0, "sphere")
    timed("train_29500_rows_20_epochs", lambda: train(manual, small, 20, validation=0.2, key=["row_id"], partitions=CPUS))

    timed("score_columns", lambda: drain(Model(small, weights).predict(samples)), total)
    timed("score_arrow", lambda: drain(Model(small, weights).predict(samples, "arrow")), total)
    vectors = embedded(spark, SF_DIR).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).persist()
    scored = vectors.count()
    timed("score_64_inputs", lambda: drain(Model(wide, formula_weights(wide)).predict(vectors)), scored)
    vectors.unpersist()
    timed("gradient_check", lambda: gradient_check_summary(samples, weights, small).agg(F.max("worst")).first(), total)

    print(
        json.dumps(
            {
                "metric": "total of the headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cores": CPUS,
                "driver_memory": MEMORY,
                "lineitem_rows": total,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
