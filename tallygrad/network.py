"""Network shape, settings, weights and the saved form of weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

Weights = list[np.ndarray]

WEIGHTS_SCHEMA = "layer int, r int, c int, w double"


@dataclass(frozen=True)
class NetworkConfig:
    """Settings of a feed-forward regression network with one output.

    ``size`` lists the units per layer, inputs first. ``hidden`` is ``sigm`` or
    ``tanh_opt``, ``output`` is ``sigm`` or ``linear``.
    """

    size: tuple[int, ...] = (10, 5, 1)
    hidden: str = "sigm"
    output: str = "sigm"
    learning_rate: float = 2.0
    momentum: float = 0.5
    rate_decay: float = 1.0
    l2: float = 0.0
    sparsity_penalty: float = 0.0
    sparsity_target: float = 0.05
    input_mask: float = 0.0
    dropout: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "size", tuple(int(n) for n in self.size))
        if len(self.size) < 3 or min(self.size) < 1:
            raise ValueError("size needs inputs, at least one hidden layer and an output")
        if self.size[-1] != 1:
            raise ValueError("the output layer must have one unit, as labels are scalars")
        if self.hidden not in ("sigm", "tanh_opt"):
            raise ValueError(f"unknown hidden activation {self.hidden!r}")
        if self.output not in ("sigm", "linear"):
            raise ValueError(f"unknown output function {self.output!r}")
        if not (0 <= self.input_mask < 1 and 0 <= self.dropout < 1):
            raise ValueError("input_mask and dropout are fractions in [0, 1)")
        if self.sparsity_penalty != 0:
            raise ValueError("sparsity_penalty has no effect on the gradient; leave it at 0")
        if self.momentum < 0 or self.l2 < 0:
            raise ValueError("momentum and l2 cannot be negative")

    @property
    def layer(self) -> int:
        return len(self.size)

    @property
    def shapes(self) -> list[tuple[int, int]]:
        """Weight matrix per layer step: (units, inputs + 1), bias in column 0."""
        return [(self.size[i + 1], self.size[i] + 1) for i in range(len(self.size) - 1)]

    @property
    def parameters(self) -> int:
        return sum(r * c for r, c in self.shapes)

    @property
    def hidden_units(self) -> int:
        return sum(self.size[1:-1])


def initial_weights(config: NetworkConfig, seed: int = 0) -> Weights:
    """Small weights, uniform in [-0.05, 0.05), bias included."""
    draw = np.random.default_rng(seed)
    return [draw.random(shape) / 10.0 - 0.05 for shape in config.shapes]


def zero_weights(config: NetworkConfig) -> Weights:
    return [np.zeros(shape) for shape in config.shapes]


def check_weights(weights: Weights, config: NetworkConfig) -> Weights:
    arrays = [np.asarray(w, dtype=float) for w in weights]
    if [a.shape for a in arrays] != config.shapes:
        raise ValueError(f"weights have shapes {[a.shape for a in arrays]}, expected {config.shapes}")
    return arrays


def flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unflatten(values: np.ndarray, config: NetworkConfig) -> Weights:
    out, start = [], 0
    for r, c in config.shapes:
        out.append(np.asarray(values[start : start + r * c], dtype=float).reshape(r, c))
        start += r * c
    return out


def positions(config: NetworkConfig) -> list[tuple[int, int, int]]:
    """(layer, r, c) of every parameter in the order of :func:`flatten`."""
    return [(l, r, c) for l, (rows, cols) in enumerate(config.shapes) for r in range(rows) for c in range(cols)]


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """Weights as rows (layer, r, c, w)."""
    rows = [(l, r, c, float(w[r, c])) for l, w in enumerate(weights) for r, c in np.ndindex(w.shape)]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def weights_from_table(df: DataFrame, config: NetworkConfig) -> Weights:
    """Read a weights table back; it has one row per network parameter."""
    weights = [np.full(shape, np.nan) for shape in config.shapes]
    count = 0
    for row in df.select("layer", "r", "c", "w").limit(config.parameters + 1).collect():
        weights[row.layer][row.r, row.c] = row.w
        count += 1
    if count != config.parameters or any(np.isnan(w).any() for w in weights):
        raise ValueError("the table does not hold each weight of the network once")
    return weights
