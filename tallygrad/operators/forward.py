"""Scoring: forward passes over tables and streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.activations import ACTIVATIONS
from ..functions.metrics import half_mean_square
from ..network import NetworkConfig, Weights, check_weights
from . import kernel

# Measured on 6 million rows: below these sizes generated code scores faster
# than Arrow batches; above, the generated method outgrows the JIT compiler and
# is many times slower.
COLUMN_LAYER_LIMIT = 64
COLUMN_TOTAL_LIMIT = 128


def _use_columns(config: NetworkConfig, method: str) -> bool:
    if method not in ("auto", "columns", "arrow"):
        raise ValueError("method must be 'auto', 'columns' or 'arrow'")
    if method != "auto":
        return method == "columns"
    largest = max(r * c for r, c in config.shapes)
    return largest <= COLUMN_LAYER_LIMIT and config.parameters <= COLUMN_TOTAL_LIMIT


def score(df: DataFrame, weights: Weights, config: NetworkConfig, method: str = "auto") -> DataFrame:
    """Add ``predict_label`` and, where a ``label`` exists, ``error`` = label - predict_label.

    Earlier columns of these names are replaced. A missing vector or element, or
    a vector of another width, is an error, whichever way is taken.

    Small networks become plain arithmetic inside whole-stage codegen, larger
    ones one matrix product per layer and Arrow batch; only the features travel
    to Python then. Neither shuffles, and both run on streams.
    """
    weights = check_weights(weights, config)
    df = df.drop("predict_label", "error")
    if _use_columns(config, method):
        scored = _score_columns(df, weights, config)
    else:
        scored = df.withColumn("predict_label", _predictor(weights, config)("features"))
    if "label" not in df.columns:
        return scored
    return scored.withColumn("error", F.col("label") - F.col("predict_label"))


def _score_columns(df: DataFrame, weights: Weights, config: NetworkConfig) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns]
    inputs = [F.get("features", F.lit(i)) for i in range(config.size[0])]
    for step, w in enumerate(weights):
        last = step == len(weights) - 1
        act = ACTIVATIONS[config.output if last else config.hidden]
        names = ["predict_label"] if last else [f"_u{step}_{r}" for r in range(w.shape[0])]
        units = []
        for r, name in enumerate(names):
            z = F.lit(float(w[r, 0]))
            for c, x in enumerate(inputs, start=1):
                z = z + F.lit(float(w[r, c])) * x
            a = act(z)
            if last:  # a missing element makes the result missing
                bad = F.raise_error(F.lit(f"features must hold vectors of width {config.size[0]} without NULL"))
                a = F.when((F.size("features") == config.size[0]) & a.isNotNull(), a).otherwise(bad)
            elif config.dropout > 0:
                a = a * F.lit(1.0 - config.dropout)
            units.append(a.alias(name))
        df = df.select(*kept, *units)
        inputs = [F.col(name) for name in names]
    return df


def _predictor(weights: Weights, config: NetworkConfig):
    @F.arrow_udf("double")
    def predict(features: pa.Array) -> pa.Array:
        x = kernel.matrix(features, config.size[0], "features")
        return pa.array(kernel.forward(x, weights, config)[-1][:, 0])

    return predict


def activations(df: DataFrame, weights: Weights, config: NetworkConfig) -> DataFrame:
    """Add ``activations``: the outputs of every layer, inputs first.

    All layers but the last start with the bias unit 1.
    """
    weights = check_weights(weights, config)
    widths = [n + 1 for n in config.size[:-1]] + [config.size[-1]]

    @F.arrow_udf("array<array<double>>")
    def outputs(features: pa.Array) -> pa.Array:
        acts = kernel.forward(kernel.matrix(features, config.size[0], "features"), weights, config)
        ones = np.ones((len(features), 1))
        flat = np.hstack([part for a in acts[:-1] for part in (ones, a)] + [acts[-1]])
        ends = np.cumsum(np.tile(widths, len(features)))
        layers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.ravel()))
        rows = pa.array(np.arange(0, len(ends) + 1, len(widths)), pa.int32())
        return pa.ListArray.from_arrays(rows, layers)

    return df.withColumn("activations", outputs("features"))


def layer_outputs(df: DataFrame, weights: Weights, config: NetworkConfig, keys: list[str]) -> DataFrame:
    """Outputs of every unit as rows (keys, layer, unit, value)."""
    arrays = activations(df.select(*keys, "features"), weights, config)
    layers = arrays.select(*keys, F.posexplode("activations").alias("layer", "outputs"))
    return layers.select(*keys, "layer", F.posexplode("outputs").alias("unit", "value"))


def loss(scored: DataFrame) -> DataFrame:
    """One row ``loss``: half the mean squared error of scored rows, NULL without rows."""
    return scored.agg(half_mean_square(F.col("error")).alias("loss"))


def hidden_means(df: DataFrame, weights: Weights, config: NetworkConfig, previous: DataFrame | None = None) -> DataFrame:
    """Mean output of every hidden unit (layer, unit, mean), units counted from 1.

    With the table of an earlier call, 0.01 of the new mean plus 0.99 of the old
    one; without, the old means are 0. Tasks add up their rows, so one vector
    per partition is shuffled.
    """
    weights = check_weights(weights, config)

    def batches(parts):
        sums = np.zeros(config.hidden_units + 1)
        for batch in parts:
            x = kernel.matrix(batch.column("features"), config.size[0], "features")
            hidden = kernel.forward(x, weights, config)[1:-1]
            sums += [*np.hstack(hidden).sum(axis=0), len(x)]
        yield pa.RecordBatch.from_arrays([kernel.vectors(sums[None, :])], names=["sums"])

    partials = df.select("features").mapInArrow(batches, "sums array<double>")
    rows = F.element_at("sums", -1).alias("rows")
    totals = (
        partials.select(rows, F.posexplode("sums").alias("pos", "v"))
        .filter(F.col("pos") < config.hidden_units)
        .groupBy("pos")
        .agg(F.try_divide(F.sum("v"), F.sum("rows")).alias("now"))
    )
    layer, before = F.lit(config.layer - 2), F.lit(config.hidden_units - config.size[-2])
    for step in range(config.layer - 3, 0, -1):
        start = sum(config.size[1:step])
        inside = F.col("pos") < start + config.size[step]
        layer, before = F.when(inside, F.lit(step)).otherwise(layer), F.when(inside, F.lit(start)).otherwise(before)
    means = totals.select(layer.alias("layer"), (F.col("pos") - before + 1).alias("unit"), "now")
    if previous is None:
        return means.select("layer", "unit", (F.lit(0.01) * F.col("now")).alias("mean"))
    old = previous.select("layer", "unit", F.col("mean").alias("old"))
    blend = F.lit(0.01) * F.col("now") + F.lit(0.99) * F.coalesce("old", F.lit(0.0))
    return means.join(old, ["layer", "unit"], "left").select("layer", "unit", blend.alias("mean"))
