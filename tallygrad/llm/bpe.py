"""BPE encoding that encodes text shared between documents once, and decoding.

Texts are cut into chunks where a rolling hash of the last bytes says so, so
equal passages give equal chunks wherever they stand. A chunk found at several
places is encoded at one of them, and its ids travel to the others by a join on
its digest. Chunks cut words apart, so the ids around every join of two chunks
are made anew from the text between the nearest positions where the
pre-tokenizer always stops; if the ids on either side have no bound there, the
stretch grows until they do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallygrad.llm.text import PIECE_BYTES, buffers, pieces
from tallygrad.llm.tokens import DEFAULT_TOKENIZER, Encoder, encoder, gathered, safe_cuts

#: Bytes under the rolling hash, bits that must be zero at a cut, and bounds of a chunk's bytes.
WINDOW, CUT_BITS, SHORTEST, LONGEST = 48, 10, 256, 8192

_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, inverse)
            )
    return _powers


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte bounds of all chunks; every text bound is one. Cuts never split a character."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * inverse[: max(0, n + 1 - WINDOW)] if n >= WINDOW else sums[:0]
    # rolled[i] covers the bytes i to i + WINDOW and proposes a cut behind them.
    proposed = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    proposed = proposed[proposed < n]
    proposed = proposed[(data[proposed] & 0xC0) != 0x80]
    cuts = [int(offsets[0])]
    at = 0
    proposals = proposed.tolist()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end == start:
            continue
        if end - start > SHORTEST:
            at = int(np.searchsorted(proposed, start + SHORTEST)) if at >= len(proposals) or proposals[at] < start or at == 0 else at
            while True:
                while at < len(proposals) and proposals[at] < start + SHORTEST:
                    at += 1
                cut = proposals[at] if at < len(proposals) else end
                if cut > start + LONGEST:
                    cut = start + LONGEST
                    while cut < end and data[cut] & 0xC0 == 0x80:
                        cut -= 1
                if cut >= end:
                    break
                cuts.append(cut)
                start = cut
        cuts.append(end)
    return np.array(cuts, np.int64)


def joined_ids(
    enc: Encoder, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, known: dict[int, bytes]
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of ids) of texts from the ids of their chunks.

    ``known`` has the ids of chunks by the byte they start at; the others are
    encoded here. Joins of chunks are repaired until the ids agree on both sides.
    """
    starts, sizes = cuts[:-1], np.diff(cuts)
    own = np.array([s not in known for s in starts.tolist()], bool)
    bounds = np.concatenate(([0], np.cumsum(sizes[own])))
    mine, reached = enc.encode(data[gathered(starts[own], sizes[own])] if len(starts) else data, bounds)
    pieces_of_ids, at = [], 0
    if len(known):
        for s, is_own in zip(starts.tolist(), own.tolist()):
            if is_own:
                pieces_of_ids.append(mine[reached[at] : reached[at + 1]])
                at += 1
            else:
                pieces_of_ids.append(np.frombuffer(known[s], enc.dtype))
        ids = np.concatenate(pieces_of_ids) if pieces_of_ids else mine
    else:
        ids = mine
    ends = np.cumsum(enc.sizes[ids])
    safe = np.unique(np.concatenate((offsets, safe_cuts(data))))
    inner = np.setdiff1d(cuts, safe)
    low = np.searchsorted(safe, inner) - 1
    high = low + 1
    if len(inner):
        while True:
            left, right = safe[low], safe[high]
            bad_left = (left > 0) & (ends[np.minimum(np.searchsorted(ends, left), len(ends) - 1)] != left)
            bad_right = ends[np.minimum(np.searchsorted(ends, right), len(ends) - 1)] != right
            if not bad_left.any() and not bad_right.any():
                break
            low = np.where(bad_left, low - 1, low)
            high = np.where(bad_right, high + 1, high)
        # Overlapping stretches become one.
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        fresh = np.concatenate(([True], low[1:] >= high[:-1]))
        low, high = low[fresh], np.maximum.reduceat(high, np.flatnonzero(fresh))
        left, right = safe[low], safe[high]
        token_starts = ends - enc.sizes[ids]
        inside = np.zeros(len(ids) + 1, np.int64)
        np.add.at(inside, np.searchsorted(token_starts, left), 1)
        np.add.at(inside, np.searchsorted(token_starts, right), -1)
        keep = np.cumsum(inside[:-1]) == 0
        lengths = right - left
        window_bounds = np.concatenate(([0], np.cumsum(lengths)))
        again, again_offsets = enc.encode(data[gathered(left, lengths)], window_bounds)
        again_starts = np.cumsum(enc.sizes[again]) - enc.sizes[again]
        again_starts += np.repeat(left - window_bounds[:-1], np.diff(again_offsets))
        position = np.concatenate((token_starts[keep], again_starts))
        order = np.argsort(position, kind="stable")
        ids = np.concatenate((ids[keep], again))[order]
        return ids, np.searchsorted(position[order], offsets)
    return ids, np.concatenate(([0], np.searchsorted(ends, offsets[1:], side="right")))


def _packed(batches):
    """Compress texts for their way through the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for batch in pieces(whole):
            data, offsets = buffers(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            texts = [pack(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary())], names=["key", "packed"])


def _unpacked(batch: pa.RecordBatch):
    """Groups of rows with their texts as flat bytes: (first row, end row, bytes, offsets)."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts, size, first = [], 0, 0
    for row, packed in enumerate(batch.column("packed")):
        text = unpack(packed.as_py())
        texts.append(text)
        size += len(text)
        if size >= PIECE_BYTES or row == batch.num_rows - 1:
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            yield first, row + 1, np.frombuffer(b"".join(texts), np.uint8), offsets
            texts, size, first = [], 0, row + 1


def _chunks(batches):
    for whole in batches:
        for first, end, data, offsets in _unpacked(whole):
            cuts = chunk_cuts(data, offsets)
            raw = data.tobytes()
            at = cuts.tolist()
            digests = [hashlib.md5(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
            owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    whole.column("key").slice(first, end - first).take(pa.array(owner)),
                    pa.array(cuts[:-1] - offsets[owner], pa.int64()),
                    pa.array(digests, pa.binary()),
                ],
                names=["key", "at", "chunk"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``key``, the MD5 of the text; null texts count as empty."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.unhex(F.md5("text")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, packed): every distinct text once, compressed. The only shuffle of whole texts."""
    return (
        keyed(docs.select("text"))
        .mapInArrow(_packed, "key binary, packed binary")
        .where(F.col("key").isNotNull())  # always true; inner joins would add it to their branch alone and undo the reuse
        .groupBy("key")
        .agg(F.first("packed").alias("packed"))
    )


def encode_texts(texts: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, ids, decoded) of rows of :func:`distinct_texts`.

    ``ids`` are little-endian unsigned 32-bit integers, the same that the library
    gives for the whole text; ``decoded`` is what they decode to, special tokens
    included.
    """

    def shared_ids(batches):
        for whole in batches:
            wanted = whole.column("wanted").to_pylist()
            for first, end, data, offsets in _unpacked(whole):
                enc = encoder(tokenizer)
                cuts = chunk_cuts(data, offsets)
                at, chunks = [], []
                for row in range(first, end):
                    for w in wanted[row]:
                        at.append(int(offsets[row - first]) + w["at"])
                        chunks.append(w["chunk"])
                starts = np.array(at, np.int64)
                sizes = cuts[np.searchsorted(cuts, starts) + 1] - starts
                ids, reached = enc.encode(
                    data[gathered(starts, sizes)], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                )
                raw, b = ids.tobytes(), (reached * ids.itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunks, pa.binary()), pa.array([raw[i:j] for i, j in zip(b[:-1], b[1:])], pa.binary())],
                    names=["chunk", "chunk_ids"],
                )

    def whole_ids(batches):
        for whole in batches:
            given = whole.column("given")
            for first, end, data, offsets in _unpacked(whole):
                enc = encoder(tokenizer)
                known = {}
                for row, several in enumerate(given.slice(first, end - first).to_pylist()):
                    for g in several or ():
                        known[int(offsets[row]) + g["at"]] = g["chunk_ids"]
                ids, reached = joined_ids(enc, data, offsets, chunk_cuts(data, offsets), known)
                decoded = enc.decode(ids)
                decoded_at = np.concatenate(([0], np.cumsum(enc.sizes[ids])))[reached]
                wide = ids.astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column("key").slice(first, end - first),
                        pa.Array.from_buffers(
                            pa.binary(),
                            end - first,
                            [None, pa.py_buffer((4 * reached).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(wide))],
                        ),
                        pa.Array.from_buffers(
                            pa.string(),
                            end - first,
                            [None, pa.py_buffer(decoded_at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(decoded))],
                        ),
                    ],
                    names=["key", "ids", "decoded"],
                )

    chunks = texts.mapInArrow(_chunks, "key binary, at bigint, chunk binary")
    place = F.struct("key", "at")
    shared = (
        chunks.groupBy("chunk")
        .agg(F.min(place).alias("owner"), F.max(place).alias("last"))
        .where(F.col("owner") != F.col("last"))
        .select("chunk", "owner")
    )
    wanted = (
        shared.select(F.col("owner.key").alias("key"), F.struct(F.col("owner.at").alias("at"), "chunk").alias("one"))
        .groupBy("key")
        .agg(F.collect_list("one").alias("wanted"))  # chunks of one text
    )
    encoded = texts.join(wanted, "key").mapInArrow(shared_ids, "chunk binary, chunk_ids binary")
    given = (
        chunks.join(encoded, "chunk")
        .groupBy("key")
        .agg(F.collect_list(F.struct("at", "chunk_ids")).alias("given"))  # chunks of one text
    )
    return texts.join(given, "key", "left").mapInArrow(whole_ids, "key binary, ids binary, decoded string")


def encode_documents(docs: DataFrame, outputs: list[Column], tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per document: doc_id and ``outputs``, expressions over ``ids`` and ``decoded``.

    Expressions are worked out where the ids are made, so long ids need not
    travel. Null texts count as empty: no ids. Rows with equal or null doc_ids
    each give a row. Other columns are ignored.
    """
    results = encode_texts(distinct_texts(docs), tokenizer).select("key", *outputs)
    return keyed(docs.select("doc_id", "text")).select("doc_id", "key").join(results, "key").drop("key")


def digests() -> list[Column]:
    return [
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
