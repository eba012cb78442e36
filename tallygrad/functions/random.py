"""Repeatable random columns.

``rand()`` depends on the partition a row happens to be in, so a retried task
or another partition count gives other numbers. These depend on row keys only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def row_key(df: DataFrame) -> Column:
    """Key of a row from all its columns; rows alike in every column share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def uniform(*keys: Column, seed: int = 0) -> Column:
    """Uniform double in [0, 1), a function of the keys and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


# Fixed values of a Lehmer generator: modulus 2**31 - 1 and multiplier.
LEHMER_MODULUS, LEHMER_STEP = 2**31 - 1, 48271


def lehmer(key: Column, epoch: Column, position: Column, seed: int = 0) -> Column:
    """Uniform double in [0, 1) by integer arithmetic that any SQL engine repeats exactly.

    ``key`` is an integer. The default draws mix better; this one is for results
    that another engine has to reproduce.
    """
    m, a = F.lit(LEHMER_MODULUS).cast("long"), F.lit(LEHMER_STEP).cast("long")
    x = F.pmod(key.cast("long"), m)
    for part in (epoch.cast("long"), position.cast("long"), F.lit(seed).cast("long"), F.lit(1).cast("long")):
        x = F.pmod(x * a + part + 1, m)
    return x / F.lit(float(LEHMER_MODULUS))


# Fixed values of the 64-bit hash behind ``xxhash64``: its primes, and the seed of Spark's function.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
HASH_SEED = np.uint64(42)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _with_int(h: np.ndarray, value) -> np.ndarray:
    """The hash after one more 32-bit integer."""
    low = np.asarray(value).astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return _avalanche(_rotated((h + _P5 + np.uint64(4)) ^ (low * _P1), 23) * _P2 + _P3)


def _with_long(h: np.ndarray, value) -> np.ndarray:
    """The hash after one more 64-bit integer."""
    step = _rotated(np.asarray(value).astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    return _avalanche(_rotated((h + _P5 + np.uint64(8)) ^ step, 27) * _P1 + _P4)


def _with_literal(h: np.ndarray, value: int) -> np.ndarray:
    """A literal counts as the type Spark gives it: an integer as long as it fits."""
    return _with_int(h, value) if -(2**31) <= value < 2**31 else _with_long(h, value)


def uniform_block(key: np.ndarray, epoch: int, positions: np.ndarray, seed: int = 0) -> np.ndarray:
    """(rows, positions) draws of :func:`uniform` over (key, epoch, position, seed), value by value the same.

    ``key`` holds 64-bit integers. What depends on the row alone is hashed once per row.
    """
    with np.errstate(over="ignore"):
        h = _with_literal(_with_long(HASH_SEED, key), epoch)
        h = _with_literal(_with_int(h[:, None], positions[None, :]), seed)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def lehmer_block(key: np.ndarray, epoch: int, positions: np.ndarray, seed: int = 0) -> np.ndarray:
    """(rows, positions) draws of :func:`lehmer`."""
    m, a = LEHMER_MODULUS, LEHMER_STEP
    x = np.mod(np.asarray(key).astype(np.int64), m)
    x = np.mod(x * a + (epoch + 1), m)[:, None]
    for part in (np.asarray(positions, np.int64)[None, :], seed, 1):
        x = np.mod(x * a + part + 1, m)
    return x / float(m)


#: How a draw that is a column is made inside a block of rows.
lehmer.in_blocks = lehmer_block
uniform.in_blocks = uniform_block

# Up to this width a vector of draws is spelled out, so that codegen compiles it.
UNROLLED = 16


def drawn_vector(size: Column | int, *keys: Column, seed: int = 0, then=lambda u: u, draw=None) -> Column:
    """ARRAY of independent uniforms, one per position, each passed through ``then``.

    ``draw`` (keys, position, seed) replaces :func:`uniform`.
    """
    if draw is not None:
        return F.transform(F.sequence(F.lit(0), F.lit(size) - 1), lambda i: then(draw(*keys, i, seed)))
    if isinstance(size, int) and size <= UNROLLED:
        return F.array(*[then(uniform(*keys, F.lit(i), seed=seed)) for i in range(size)])
    return F.transform(F.array_repeat(F.lit(0), size), lambda _, i: then(uniform(*keys, i, seed=seed)))
