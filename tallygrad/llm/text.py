"""Whole Arrow batches of text as flat numpy arrays: words, hashes and word n-grams.

Texts stay in the UTF-8 buffers Arrow delivers; nothing here makes one Python
object per word. Words are maximal runs of bytes other than space and
0x09-0x0D. Hashes are 64 bits wide and depend on the bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a range that are hashed in one go.
SEGMENT_BYTES = 256
#: The lowest 0 to 8 bytes of a lane.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or first == last:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[first:last], offsets.astype(np.int64) - first


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``size`` bytes of text each, whole rows only."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a column of texts: byte bounds, and the first word of every text."""

    def __init__(self, column: pa.Array, separator: np.ndarray = _SEPARATOR, lower: bool = False):
        data, self.offsets = buffers(column)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~separator[self.data]
        edges = self.offsets
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[:1] = False
        before[edges[edges < n]] = False
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        after[n - 1 :] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Text t has the words first[t] to first[t + 1].
        self.first = np.searchsorted(self.starts, edges)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def array(self) -> pa.Array:
        """The words as one binary Arrow array."""
        sizes = self.ends - self.starts
        kept = np.concatenate(([0], np.cumsum(sizes)))
        index = np.repeat(self.starts - kept[:-1], sizes) + np.arange(kept[-1])
        return pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(self.data[index])]
        )

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``data``.

    Eight bytes at a time go through :func:`mixed`, so that no sum or product of
    bytes makes ranges of a certain form collide. A range of more than
    SEGMENT_BYTES is hashed in segments, then as the text of their hashes.
    """
    sizes = ends - starts
    large = np.flatnonzero(sizes > SEGMENT_BYTES)
    if not len(large):
        return _lane_hashes(data, starts, sizes)
    out = np.empty(len(sizes), np.uint64)
    small = np.flatnonzero(sizes <= SEGMENT_BYTES)
    out[small] = _lane_hashes(data, starts[small], sizes[small])
    count = -(-sizes[large] // SEGMENT_BYTES)
    bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(starts[large] - SEGMENT_BYTES * bounds[:-1], count) + SEGMENT_BYTES * np.arange(bounds[-1])
    parts = _lane_hashes(data, at, np.minimum(SEGMENT_BYTES, np.repeat(ends[large], count) - at))
    whole = span_hashes(parts.view(np.uint8), 8 * bounds[:-1], 8 * bounds[1:])
    with np.errstate(over="ignore"):
        out[large] = mixed(whole + sizes[large].astype(np.uint64) * _BASE)
    return out


def _lane_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of ranges of at most SEGMENT_BYTES, eight bytes of all of them in one step."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        out = sizes.astype(np.uint64) * _BASE
        rows, at, left, state = None, starts, sizes, out
        while len(at):
            lane = lanes[at]
            lane &= _LOW_BYTES[np.minimum(left, 8)]
            state = mixed(state ^ lane)
            if rows is None:
                out = state
            else:
                out[rows] = state
            on = np.flatnonzero(left > 8)
            rows, at, left = on if rows is None else rows[on], at[on] + 8, left[on] - 8
            state = state[on]
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes, across text bounds as well."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mixed(total)


def grams(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of all k-word runs that lie within one text."""
    g = gram_hashes(hashes, k)
    owner = words.owner()
    at = np.flatnonzero(owner[: len(g)] == owner[k - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    return owner[at], at - words.first[owner[at]], g[at]


def shingle_sets(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, in order; a shorter text has its whole sequence as one."""
    owner, _, g = grams(words, hashes, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    more = np.zeros(len(short), np.uint64)
    for m in range(1, k):
        which = np.flatnonzero(words.counts[short] == m)
        if len(which):
            at = words.first[short[which]]
            more[which] = gram_hashes(hashes, m)[at]
    owner, g = np.concatenate((owner, short)), np.concatenate((g, more))
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], g[fresh]
