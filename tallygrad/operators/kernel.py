"""Per-batch network arithmetic used inside Arrow tasks.

Spark partitions the rows and adds up what tasks return; these helpers only
turn one Arrow batch into matrices and run one matrix product per layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.activations import TANH_RATE, TANH_SCALE
from ..network import NetworkConfig, Weights


def matrix(column: pa.Array, width: int, name: str) -> np.ndarray:
    """(rows, width) matrix of an ARRAY<DOUBLE> column; a missing value or another width is an error."""
    if column.null_count:
        raise ValueError(f"{name} holds a NULL vector")
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"{name} must hold vectors of width {width}")
    values = column.flatten()
    if values.null_count:
        raise ValueError(f"{name} holds a NULL element")
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def numbers(column: pa.Array, name: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"{name} holds a NULL")
    return column.to_numpy(zero_copy_only=False)


def vectors(values: np.ndarray) -> pa.Array:
    """ARRAY<DOUBLE> column of a matrix, without a copy of the values."""
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _activate(z: np.ndarray, name: str) -> np.ndarray:
    if name == "sigm":
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))
    return TANH_SCALE * np.tanh(z * TANH_RATE) if name == "tanh_opt" else z


def _slope(a: np.ndarray, name: str) -> np.ndarray:
    if name == "sigm":
        return a * (1.0 - a)
    if name == "tanh_opt":
        return TANH_SCALE * TANH_RATE * (1.0 - a * a / TANH_SCALE**2)
    return np.ones_like(a)


#: For each hidden layer, 0/1 per row and unit.
Masks = list[np.ndarray]


def layer_masks(keep: np.ndarray, config: NetworkConfig) -> Masks:
    """One mask over all hidden units, cut by layer."""
    return np.split(keep, np.cumsum(config.size[1:-2]), axis=1)


def layer_input(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the units of a layer get from the outputs before it; any number of leading dimensions."""
    return a @ np.ascontiguousarray(w[:, 1:].T) + w[:, 0]


def layer_output(
    z: np.ndarray, step: int, config: NetworkConfig, keep: Masks | None = None, unit: int | None = None
) -> np.ndarray:
    """Outputs of layer ``step`` for inputs of shape (rows, ..., units), or (rows, ...) inputs of its one ``unit``."""
    if step == len(config.size) - 2:
        return _activate(z, config.output)
    a = _activate(z, config.hidden)
    if keep is not None:
        mask = keep[step] if unit is None else keep[step][:, unit]
        middle = z.ndim - mask.ndim
        return a * mask.reshape(mask.shape[:1] + (1,) * middle + mask.shape[1:])
    return a * (1.0 - config.dropout) if config.dropout > 0 else a


def forward(x: np.ndarray, weights: Weights, config: NetworkConfig, keep: Masks | None = None) -> list[np.ndarray]:
    """Outputs of every layer, the input included, without bias columns.

    ``keep`` holds 0/1 per hidden unit for training with dropout; without it
    hidden outputs are scaled by the share of units kept.
    """
    acts = [x]
    for step, w in enumerate(weights):
        acts.append(layer_output(layer_input(acts[-1], w), step, config, keep))
    return acts


def gradient_sums(
    acts: list[np.ndarray],
    y: np.ndarray,
    weights: Weights,
    config: NetworkConfig,
    keep: Masks | None = None,
    used: np.ndarray | None = None,
) -> Weights:
    """Sum over the batch, or its ``used`` rows, of the derivatives of half the squared error."""
    deltas = _deltas(acts, y, weights, config, keep, used)
    return [np.hstack([d.sum(axis=0)[:, None], d.T @ a]) for d, a in zip(deltas, acts)]


def row_gradients(
    acts: list[np.ndarray], y: np.ndarray, weights: Weights, config: NetworkConfig, keep: Masks | None = None
) -> np.ndarray:
    """(rows, parameters) derivatives, in the order of ``network.flatten``."""
    rows = len(y)
    parts = []
    for d, a in zip(_deltas(acts, y, weights, config, keep), acts):
        inputs = np.hstack([np.ones((rows, 1)), a])
        parts.append((d[:, :, None] * inputs[:, None, :]).reshape(rows, -1))
    return np.hstack(parts)


def _deltas(acts, y, weights, config, keep=None, used=None) -> list[np.ndarray]:
    out = acts[-1]
    last = (out - y[:, None]) * _slope(out, config.output)
    deltas = [last if used is None else np.where(used[:, None], last, 0.0)]
    for step in range(len(weights) - 1, 0, -1):
        a = acts[step]
        # Without a mask hidden outputs are scaled, so the slope is that of the output before, times the scale.
        share = 1.0 - config.dropout if keep is None else 1.0
        d = (deltas[0] @ weights[step][:, 1:]) * _slope(a / share if share else a, config.hidden) * share
        if keep is not None:
            d = d * keep[step - 1]
        deltas.insert(0, d)
    return deltas
