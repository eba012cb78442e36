"""Numeric check of the gradient: central differences against back-propagation.

Rows that bring masked features (``noisy``) or a dropout mask (``keep``) are
checked under them; without a mask, a network with dropout is checked as it scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..network import NetworkConfig, Weights, check_weights, flatten, unflatten
from . import kernel
from .gradient import place_columns

STEP = 1e-4
# Rows are worked on in slices, so that a task holds at most this many derivatives.
SLICE_VALUES = 2_000_000


def _differences(
    x: np.ndarray, y: np.ndarray, weights: Weights, config: NetworkConfig, step: float, keep: kernel.Masks | None = None
) -> np.ndarray:
    """(rows, parameters) central differences of half the squared error.

    Moving weight (r, c) of a layer moves the input of unit r by the step times
    output c of the layer before, and nothing else of that layer. So one forward
    pass is kept, and for all weights of a unit at once the change is carried
    through the layers behind: the next one as a product of the unit's change
    with its weights there, only those after that as whole layers.
    """
    acts = kernel.forward(x, weights, config, keep)
    inputs = [kernel.layer_input(a, w) for a, w in zip(acts, weights)]
    out = np.empty((len(y), config.parameters))
    at = 0
    for layer, w in enumerate(weights):
        reach = step * np.hstack([np.ones((len(y), 1)), acts[layer]])
        for r in range(len(w)):
            halves = []
            for moved in (inputs[layer][:, r : r + 1] + reach, inputs[layer][:, r : r + 1] - reach):
                a = kernel.layer_output(moved, layer, config, keep, r)
                if layer + 1 < len(weights):
                    change = a - acts[layer + 1][:, r : r + 1]
                    behind = weights[layer + 1]
                    z = inputs[layer + 1][:, None, :] + change[:, :, None] * behind[:, r + 1]
                    a = kernel.layer_output(z, layer + 1, config, keep)
                    for later in range(layer + 2, len(weights)):
                        a = kernel.layer_output(kernel.layer_input(a, weights[later]), later, config, keep)
                    a = a[:, :, 0]
                halves.append(0.5 * (a - y[:, None]) ** 2)
            out[:, at : at + w.shape[1]] = (halves[0] - halves[1]) / (2.0 * step)
            at += w.shape[1]
    return out


def _given(df: DataFrame) -> list[str]:
    """Columns of the noise that a row was trained with, where they are there."""
    return [c for c in ("noisy", "keep") if c in df.columns]


def _parts(batch: pa.RecordBatch, config: NetworkConfig):
    """(features, label, dropout mask or None) of a batch; masked features take the place of clean ones."""
    names = batch.schema.names
    source = "noisy" if "noisy" in names else "features"
    x = kernel.matrix(batch.column(source), config.size[0], source)
    keep = kernel.matrix(batch.column("keep"), config.hidden_units, "keep") if "keep" in names else None
    return x, kernel.numbers(batch.column("label"), "label"), None if keep is None else kernel.layer_masks(keep, config)


def _slices(batch: pa.RecordBatch, config: NetworkConfig):
    rows = max(1, SLICE_VALUES // config.parameters)
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def row_gradients(df: DataFrame, weights: Weights, config: NetworkConfig, keys: list[str]) -> DataFrame:
    """Derivatives of every row's loss as rows (keys, layer, r, c, g): the outer
    products of each layer's deltas with the outputs before it."""
    weights = check_weights(weights, config)
    samples = df.select(*keys, "label", "features", *_given(df))

    def batches(parts):
        for batch in (part for whole in parts for part in _slices(whole, config)):
            x, y, keep = _parts(batch, config)
            grads = kernel.row_gradients(kernel.forward(x, weights, config, keep), y, weights, config, keep)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), kernel.vectors(grads)], names=[*keys, "grads"]
            )

    schema = StructType(
        [f for f in samples.schema.fields if f.name in keys] + [StructField("grads", ArrayType(DoubleType()))]
    )
    exploded = samples.mapInArrow(batches, schema).select(*keys, F.posexplode("grads").alias("pos", "g"))
    layer, r, c = place_columns(F.col("pos"), config)
    return exploded.select(*keys, layer, r, c, "g")


def gradient_check(
    df: DataFrame, weights: Weights, config: NetworkConfig, keys: list[str], step: float = STEP
) -> DataFrame:
    """Both gradients of every row: (keys, layer, r, c, estimate, actual, ratio).

    Gives one output row per weight and sample; :func:`gradient_check_summary`
    adds up inside the tasks.
    """
    weights = check_weights(weights, config)
    samples = df.select(*keys, "label", "features", *_given(df))

    def batches(parts):
        for batch in (part for whole in parts for part in _slices(whole, config)):
            x, y, keep = _parts(batch, config)
            estimate = _differences(x, y, weights, config, step, keep)
            actual = kernel.row_gradients(kernel.forward(x, weights, config, keep), y, weights, config, keep)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), kernel.vectors(estimate), kernel.vectors(actual)],
                names=[*keys, "estimates", "actuals"],
            )

    vector = ArrayType(DoubleType())
    schema = StructType(
        [f for f in samples.schema.fields if f.name in keys]
        + [StructField("estimates", vector), StructField("actuals", vector)]
    )
    both = samples.mapInArrow(batches, schema).select(
        *keys, F.posexplode(F.arrays_zip("estimates", "actuals")).alias("pos", "pair")
    )
    layer, r, c = place_columns(F.col("pos"), config)
    return both.select(
        *keys, layer, r, c, F.col("pair.estimates").alias("estimate"), F.col("pair.actuals").alias("actual")
    ).withColumn("ratio", F.try_divide("estimate", "actual"))


def gradient_check_summary(df: DataFrame, weights: Weights, config: NetworkConfig, step: float = STEP) -> DataFrame:
    """Per weight over all rows: (layer, r, c, n, estimate, actual, ratio, worst).

    ``estimate`` and ``actual`` are averages, ``worst`` is the largest
    difference in any one row.
    """
    weights = check_weights(weights, config)

    def batches(parts):
        n = 0
        sums = np.zeros((2, config.parameters))
        worst = np.zeros(config.parameters)
        for batch in (part for whole in parts for part in _slices(whole, config)):
            x, y, keep = _parts(batch, config)
            estimate = _differences(x, y, weights, config, step, keep)
            actual = kernel.row_gradients(kernel.forward(x, weights, config, keep), y, weights, config, keep)
            n += len(y)
            sums += [estimate.sum(axis=0), actual.sum(axis=0)]
            worst = np.maximum(worst, np.abs(estimate - actual).max(axis=0))
        columns = [np.full(config.parameters, float(n)), sums[0], sums[1], worst]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(config.parameters, dtype=np.int32)), *(pa.array(v) for v in columns)],
            names=["pos", "n", "estimate", "actual", "worst"],
        )

    partials = df.select("label", "features", *_given(df)).mapInArrow(
        batches, "pos int, n double, estimate double, actual double, worst double"
    )
    totals = partials.groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum("estimate").alias("e"), F.sum("actual").alias("a"), F.max("worst").alias("worst")
    )
    layer, r, c = place_columns(F.col("pos"), config)
    return totals.select(
        layer,
        r,
        c,
        F.col("n").cast("long").alias("n"),
        F.try_divide("e", "n").alias("estimate"),
        F.try_divide("a", "n").alias("actual"),
        F.try_divide("e", "a").alias("ratio"),
        "worst",
    )
