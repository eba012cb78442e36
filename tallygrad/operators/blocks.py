"""Training rows packed into blocks.

An epoch moves every training row from the JVM to Python. Row by row that costs
far more than the arithmetic; as blocks of a few thousand rows, each a piece of
raw little-endian memory, it halves the time of an epoch. Packing happens once,
before the table is stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from . import kernel

BLOCK_SCHEMA = "rows int, label binary, features binary, is_valid binary, row_key binary"
BLOCK_BYTES = 512 * 1024


def block_rows(width: int) -> int:
    """Rows of one block, so that it stays near BLOCK_BYTES."""
    return max(1, BLOCK_BYTES // (8 * (width + 1) + 1))


def is_blocked(df: DataFrame) -> bool:
    return isinstance(df.schema["features"].dataType, BinaryType)


def to_blocks(df: DataFrame, width: int) -> DataFrame:
    """Blocks of (label, features) rows with vectors of a known width, and ``is_valid`` and ``row_key`` where they exist.

    The key (a 64-bit integer) is what draws inside the blocks depend on.
    """
    has_valid, has_key = "is_valid" in df.columns, "row_key" in df.columns
    step = block_rows(width)

    def batches(parts):
        for whole in parts:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                y = kernel.numbers(batch.column("label"), "label")
                x = kernel.matrix(batch.column("features"), width, "features")
                held = kernel.numbers(batch.column("is_valid"), "is_valid") if has_valid else np.zeros(len(y))
                keys = kernel.numbers(batch.column("row_key"), "row_key") if has_key else np.zeros(0)
                pieces = [y.astype("<f8"), x.astype("<f8"), held.astype("u1"), keys.astype("<i8")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(y)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in pieces)],
                    names=["rows", "label", "features", "is_valid", "row_key"],
                )

    wanted = ["label", "features", *(["is_valid"] if has_valid else []), *(["row_key"] if has_key else [])]
    return df.select(*wanted).mapInArrow(batches, BLOCK_SCHEMA)


def unpacked(batch: pa.RecordBatch, width: int):
    """(labels, features, is_valid, row keys) of every block, without copying; no keys where the rows had none."""
    columns = (batch.column(c) for c in ("label", "features", "is_valid", "row_key"))
    for y, x, held, keys in zip(*columns):
        features = np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width)
        is_valid = np.frombuffer(held.as_buffer(), "u1").astype(bool)
        yield np.frombuffer(y.as_buffer(), "<f8"), features, is_valid, np.frombuffer(keys.as_buffer(), "<i8")
