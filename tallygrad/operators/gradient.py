"""Gradient and losses of a whole table in one job, and the weight update.

Each task sums the derivatives of its rows into one vector, so what crosses
the network is one vector per partition, whatever the row count. The vectors
are added up as a whole in a few tasks and then in one, and the driver receives
one array. A table of the gradient is exploded from finished sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.random import uniform_block
from ..network import NetworkConfig, Weights, check_weights, flatten, unflatten, zero_weights
from . import kernel
from .blocks import is_blocked, unpacked

# Tasks that add up the vectors of all partitions before one task adds up theirs.
COMBINE_TASKS = 8

# Totals that follow the derivatives in a partial vector.
TOTALS = ("train_rows", "train_sse", "valid_rows", "valid_sse")


@dataclass(frozen=True)
class Noise:
    """Masks of one epoch's training pass, drawn inside the blocks from row keys.

    ``draw`` (key, epoch, positions, seed) gives uniforms, see
    :func:`..functions.random.uniform_block`; inputs and hidden units are drawn
    as the columns of :mod:`.samples` are, with the same seeds.
    """

    epoch: int
    seed: int = 0
    draw: Callable = uniform_block

    def inputs(self, x: np.ndarray, keys: np.ndarray, config: NetworkConfig) -> np.ndarray:
        """Features with the masked ones at 0; the draws of a row's features are one matrix."""
        if config.input_mask <= 0:
            return x
        return x * (self.draw(keys, self.epoch, np.arange(config.size[0]), self.seed) >= config.input_mask)

    def units(self, keys: np.ndarray, config: NetworkConfig) -> kernel.Masks | None:
        """The mask of each hidden layer, a layer drawn at a time; positions count over all hidden units."""
        if config.dropout <= 0:
            return None
        masks, first = [], 0
        for width in config.size[1:-1]:
            positions = np.arange(first, first + width)
            masks.append((self.draw(keys, self.epoch, positions, self.seed + 1) > config.dropout).astype(np.float64))
            first += width
        return masks


def partial_sums(
    df: DataFrame, weights: Weights, config: NetworkConfig, gradient: bool = True, noise: Noise | None = None
) -> DataFrame:
    """One vector ``sums`` per partition: derivatives over training rows, then TOTALS.

    Takes blocks, or rows with ``label``, ``features`` and, where present,
    ``is_valid`` (rows that only count for the validation loss), ``noisy`` (masked
    features for the training pass) and ``keep`` (dropout mask). For blocks the
    masks are drawn here, as ``noise`` says, and used again on the way back. Losses
    always come from a clean forward pass, which also serves the gradient unless
    noise is asked for.
    """
    weights = check_weights(weights, config)
    blocked, width = is_blocked(df), config.size[0]
    if noise is not None and not blocked:
        raise ValueError("noise is drawn inside blocks; rows bring theirs as columns")
    wanted = [c for c in ("label", "features", "is_valid", "row_key" if blocked else "", "noisy", "keep") if c in df.columns]
    has_noise = noise is not None or "noisy" in wanted or "keep" in wanted
    # The weights ride in the closure, which Spark sends as a broadcast once it passes 1 MB.

    def rows(batch):
        y = kernel.numbers(batch.column("label"), "label")
        held = np.zeros(len(y), bool)
        if "is_valid" in wanted:
            held = kernel.numbers(batch.column("is_valid"), "is_valid").astype(bool)
        yield y, kernel.matrix(batch.column("features"), width, "features"), held, None

    def noisy_pass(batch, x, keys):
        if noise is not None:
            if len(keys) != len(x):
                raise ValueError("blocks hold no row keys to draw by")
            source, keep = noise.inputs(x, keys, config), noise.units(keys, config)
            return kernel.forward(source, weights, config, keep), keep
        keep = kernel.matrix(batch.column("keep"), config.hidden_units, "keep") if "keep" in wanted else None
        keep = None if keep is None else kernel.layer_masks(keep, config)
        source = kernel.matrix(batch.column("noisy"), width, "noisy") if "noisy" in wanted else x
        return kernel.forward(source, weights, config, keep), keep

    def batches(parts):
        grad = np.zeros(config.parameters)
        totals = np.zeros(len(TOTALS))
        for batch in parts:
            for y, x, held, keys in unpacked(batch, width) if blocked else rows(batch):
                acts, keep, train = kernel.forward(x, weights, config), None, ~held
                squares = (y - acts[-1][:, 0]) ** 2
                totals += [train.sum(), squares[train].sum(), held.sum(), squares[held].sum()]
                if gradient:
                    if has_noise:
                        acts, keep = noisy_pass(batch, x, keys)
                    grad += flatten(kernel.gradient_sums(acts, y, weights, config, keep, train))
        sums = np.concatenate([grad, totals])[None, :]
        yield pa.RecordBatch.from_arrays([kernel.vectors(sums)], names=["sums"])

    return df.select(*wanted).mapInArrow(batches, "sums array<double>")


def combined(partials: DataFrame, tasks: int) -> DataFrame:
    """Partial vectors added up in ``tasks`` tasks, one vector each; they travel whole, batch by batch."""

    def batches(parts):
        total = None
        for batch in parts:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            block = kernel.matrix(batch.column(0), int(lengths[0]), "sums").sum(axis=0) if len(lengths) else None
            if block is not None:
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([kernel.vectors(total[None, :])], names=["sums"])

    return partials.repartition(tasks).mapInArrow(batches, "sums array<double>")


def summed(partials: DataFrame, combine_tasks: int = COMBINE_TASKS) -> DataFrame:
    """Element-wise sum of the partial vectors as one row ``sums``, none without partitions."""
    return combined(combined(partials, combine_tasks) if combine_tasks > 1 else partials, 1)


# Derivatives of one slice of a vector that is added up apart from the others.
SLICE = 4096


def sliced_sums(partials: DataFrame, width: int, combine_tasks: int = COMBINE_TASKS, size: int = SLICE) -> DataFrame:
    """Element-wise sums of the first ``width`` elements as rows (slice, rows, sums), for tables of any width.

    Every task's vector is cut to slices of ``size``; those with the same number are
    added up in ``combine_tasks`` groups and then into one, so no task holds more than a
    few slices and nothing is exploded. ``rows`` adds up the element behind ``width``.
    """
    last = -(-width // size) - 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.slice("sums", i * size + 1, F.least(F.lit(size), width - i * size)))
    parts = partials.select(
        F.posexplode(cut).alias("slice", "sums"),
        F.element_at("sums", width + 1).alias("rows"),
        (F.spark_partition_id() % combine_tasks).alias("part"),
    )

    def batches(stream):
        sums, rows = {}, {}
        for batch in stream:
            for number, n, values in zip(batch.column("slice").to_pylist(), batch.column("rows").to_pylist(), batch.column("sums")):
                vector = values.values.to_numpy()
                sums[number] = sums[number] + vector if number in sums else vector.copy()
                rows[number] = rows.get(number, 0.0) + n
        for number in sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([rows[number]]), kernel.vectors(sums[number][None, :])],
                names=["slice", "rows", "sums"],
            )

    schema = "slice int, rows double, sums array<double>"
    some = parts.repartition("slice", "part").select("slice", "rows", "sums").mapInArrow(batches, schema)
    return some.repartition("slice").mapInArrow(batches, schema)


def place_columns(pos: Column, config: NetworkConfig) -> tuple[Column, Column, Column]:
    """Columns (layer, r, c) of a flat weight position."""
    starts = np.cumsum([0] + [rows * cols for rows, cols in config.shapes])
    layer = r = c = None
    for step in reversed(range(len(config.shapes))):
        cols = config.shapes[step][1]
        inside = pos - F.lit(int(starts[step]))
        here = (F.lit(step), F.floor(inside / F.lit(cols)).cast("int"), (inside % F.lit(cols)).cast("int"))
        if layer is None:
            layer, r, c = here
        else:
            before = pos < F.lit(int(starts[step + 1]))
            layer, r, c = (F.when(before, a).otherwise(b) for a, b in zip(here, (layer, r, c)))
    return layer.alias("layer"), r.alias("r"), c.alias("c")


def gradient_table(
    df: DataFrame, weights: Weights, config: NetworkConfig, combine_tasks: int = COMBINE_TASKS
) -> DataFrame:
    """Gradient over the training rows as rows (layer, r, c, g_sum, n, g).

    ``g_sum`` is the sum over rows, ``n`` their count and ``g`` the average.
    """
    totals = sliced_sums(partial_sums(df, weights, config), config.parameters, combine_tasks).select(
        F.col("rows").alias("n"), "slice", F.posexplode("sums").alias("at", "g_sum")
    )
    layer, r, c = place_columns(F.col("slice") * SLICE + F.col("at"), config)
    return totals.select(layer, r, c, "g_sum", F.col("n").cast("long").alias("n"), F.try_divide("g_sum", "n").alias("g"))


@dataclass
class PassResult:
    """What one job over the table tells about one set of weights."""

    gradient: Weights
    train_rows: int
    train_loss: float | None
    valid_rows: int
    valid_loss: float | None


def run_pass(
    df: DataFrame,
    weights: Weights,
    config: NetworkConfig,
    gradient: bool = True,
    combine_tasks: int = COMBINE_TASKS,
    noise: Noise | None = None,
) -> PassResult:
    """One query: average gradient and both losses. The driver receives one array of P + 4 numbers."""
    values = np.zeros(config.parameters + len(TOTALS))
    for row in summed(partial_sums(df, weights, config, gradient, noise), combine_tasks).collect():
        values += row.sums
    n_train, sse_train, n_valid, sse_valid = values[config.parameters :].tolist()
    grads = values[: config.parameters] / n_train if n_train else values[: config.parameters]
    return PassResult(
        unflatten(grads, config),
        int(n_train),
        0.5 * sse_train / n_train if n_train else None,
        int(n_valid),
        0.5 * sse_valid / n_valid if n_valid else None,
    )


def update(
    weights: Weights, velocity: Weights | None, gradient: Weights, config: NetworkConfig, rate: float
) -> tuple[Weights, Weights]:
    """New weights and velocity after one step.

    The penalty leaves the bias out; momentum is not multiplied by the rate.
    """
    velocity = zero_weights(config) if velocity is None else velocity
    new_w, new_v = [], []
    for w, v, g in zip(weights, velocity, gradient):
        if config.l2 > 0:
            penalty = config.l2 * w
            penalty[:, 0] = 0.0
            g = g + penalty
        step = rate * g
        if config.momentum > 0:
            step = step + config.momentum * v
            v = step
        new_w.append(w - step)
        new_v.append(v)
    return new_w, new_v


def update_table(
    weights: DataFrame, gradients: DataFrame, velocity: DataFrame | None, config: NetworkConfig, rate: float
) -> DataFrame:
    """:func:`update` on tables: (layer, r, c, w, v) from (…, w), (…, g) and (…, v)."""
    place = ["layer", "r", "c"]
    joined = weights.select(*place, "w").join(gradients.select(*place, "g"), place)
    if velocity is None:
        joined = joined.withColumn("v", F.lit(0.0))
    else:
        joined = joined.join(velocity.select(*place, "v"), place)
    penalty = F.when(F.col("c") > 0, F.col("w") * F.lit(config.l2)).otherwise(F.lit(0.0))
    step = F.lit(rate) * (F.col("g") + penalty) + F.lit(config.momentum) * F.col("v")
    stepped = joined.select(*place, "w", "v", step.alias("step"))
    velocity_after = F.col("step") if config.momentum > 0 else F.col("v")
    return stepped.select(*place, (F.col("w") - F.col("step")).alias("w"), velocity_after.alias("v"))
