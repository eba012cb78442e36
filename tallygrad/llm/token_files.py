"""Token ids of documents as Parquet files that can be read in part.

Layout: rows in ascending doc_id over ascending files. ``ids`` is a list column
of 32-bit integers whose dictionary (the vocabulary bounds it) packs every id
into as few bits as the file needs; where a row group holds too many different
ids for the dictionary page the writer falls back to delta packing (format
version 2). ``part``, ``start_in_part`` and ``n_tokens`` stay apart from the ids, so
offsets are read without touching them, and page indexes and row group bounds
let a reader of a few documents skip the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallygrad.llm.text import buffers, pieces
from tallygrad.llm.tokens import DEFAULT_TOKENIZER, encoder

#: Bytes of a row group and of a page.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
END_ID = 0

_SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"


def encoded_in_order(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Ids of each whole text with ``end_id`` behind them, in ascending doc_id over ascending partitions.

    Null texts count as empty and give the end id alone; null doc_ids come
    first; repeated rows stay. Equal doc_ids keep no particular order among
    themselves. Other columns are ignored.
    """

    def encode(batches):
        start = 0
        for whole in batches:
            for batch in pieces(whole):
                enc = encoder(tokenizer)
                ids, offsets = enc.encode(*buffers(batch.column("text")))
                all_ids = np.insert(ids.astype(np.int32), offsets[1:], end_id)
                bounds = offsets + np.arange(len(offsets))
                counts = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("part"),
                        pa.array(start + bounds[:-1], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(all_ids, pa.int32())),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    # The order is by doc_id alone, so that drawing the range bounds reads no text.
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(encode, _SCHEMA)


def write_token_files(encoded: DataFrame, path: str) -> None:
    """Write rows of :func:`encoded_in_order` in the layout above."""
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.dictionary.page.size", str(PAGE_BYTES))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; row groups and pages without them are skipped."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids))


def document_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens) with ``start`` = ids of all documents before; reads no ids.

    One row per file part goes through one task to be summed up; it is joined
    back as a broadcast of a few bytes per part.
    """
    rows = read_token_files(spark, path).select("doc_id", "part", "start_in_part", "n_tokens")
    return with_starts(rows, rows)


def with_starts(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        metadata.groupBy("part")
        .agg(F.sum("n_tokens").alias("in_part"))
        .select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before_part"))
    )
    return (
        rows.join(F.broadcast(parts), "part")
        .withColumn("start", F.col("before_part") + F.col("start_in_part"))
        .drop("before_part", "start_in_part")
    )


def with_checksums(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def checked(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4"))).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"]
            )

    kept = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "ids")
    return rows.mapInArrow(checked, f"{schema}, ids_crc32 bigint")
