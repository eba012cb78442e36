"""Removal of long word sequences that already stand in an earlier document.

A window of ``WINDOW`` words is an edge of a De Bruijn graph. Windows in a row
whose smallest ``ANCHOR``-word n-gram is the same one form a path, and equal
windows always share that anchor, so all copies of a window meet where paths
are grouped by anchor:

- an anchor that stands in one document only needs nothing more;
- a path that also stands in a smaller document goes as a whole, all its
  windows with it, so most copies are decided path by path;
- where paths of one anchor differ, the graph branches: one occurrence of each
  of these paths is taken apart, and its windows are grouped one by one.

The joins carry hashes and ids. Texts are shuffled once, compressed, to be
joined with what was found for their document. Windows count as equal when two
64-bit hashes agree: anchor and path, or anchor and window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.store import kept
from tallygrad.llm.text import Words, gram_hashes, mixed, pieces, span_hashes

WINDOW, ANCHOR = 13, 4
#: Bytes of text worked on at once; a window takes many times the memory of its text.
STEP_BYTES = 512 << 10


class Windows:
    """All windows of a column of texts: first word, anchor hash, and the paths they form."""

    def __init__(self, column: pa.Array, window: int = WINDOW, anchor: int = ANCHOR):
        self.words = words = Words(column)
        self.window = window
        self.hashes = words.hashes()
        self.owner = words.owner()
        n = len(words) - window + 1
        if n <= 0:
            self.at = self.place = np.zeros(0, np.int64)
            self.anchors = np.zeros(0, np.uint64)
            return
        grams = gram_hashes(self.hashes, anchor)
        least, place = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - anchor + 1):
            other = grams[j : j + n]
            better = other < least
            least[better] = other[better]
            place[better] = j
        self.at = np.flatnonzero(self.owner[:n] == self.owner[window - 1 :])
        self.anchors = least[self.at]
        self.place = self.at + place[self.at]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, anchor hash, path hash) of each run of windows with one anchor."""
        if not len(self.at):
            return np.zeros(0, np.int64), self.anchors, self.anchors
        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(self.at) != 1) | (np.diff(self.place) != 0))))
        last = np.append(fresh[1:], len(self.at)) - 1
        start, end = self.at[fresh], self.at[last] + self.window
        words = span_hashes(self.hashes.view(np.uint8), 8 * start, 8 * end)
        with np.errstate(over="ignore"):
            value = mixed(words + mixed(((end - start) * 64 + self.place[fresh] - start).astype(np.uint64)))
        return fresh, self.anchors[fresh], value

    def path_of_window(self) -> np.ndarray:
        fresh, _, path = self.paths()
        return np.repeat(path, np.diff(np.append(fresh, len(self.at))))

    def window_hashes(self) -> np.ndarray:
        return gram_hashes(self.hashes, self.window)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Words that lie in a window for which ``hit`` holds."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, self.at[hit], 1)
        np.add.at(edge, self.at[hit] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _distinct_rows(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[fresh] for c in columns]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_paths: bool = True) -> DataFrame:
    """(anchor, doc_id, path) of all paths of documents with an id; without paths one row per anchor and document."""

    def found(batches):
        for whole in batches:
            for batch in pieces(whole, size=STEP_BYTES):
                windows = Windows(batch.column("text"), window, anchor)
                fresh, a, path = windows.paths()
                owner = windows.owner[windows.at[fresh]]
                if with_paths:
                    owner, a, path = _distinct_rows(owner, a, path)
                else:
                    owner, a = _distinct_rows(owner, a)
                out = [_signed(a), batch.column("doc_id").take(pa.array(owner))]
                yield pa.RecordBatch.from_arrays(
                    out + [_signed(path)] * with_paths, names=["anchor", "doc_id"] + ["path"] * with_paths
                )

    schema = "anchor bigint, doc_id bigint" + ", path bigint" * with_paths
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(found, schema)


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for batch in pieces(whole, size=STEP_BYTES):
            texts = [None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _unpacked(whole: pa.RecordBatch):
    """(first row, end row, text column) of groups of rows."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts, size, first = [], 0, 0
    for row, packed in enumerate(whole.column("packed").to_pylist()):
        text = b"" if packed is None else unpack(packed)
        texts.append(text)
        size += len(text)
        if size >= STEP_BYTES or row == whole.num_rows - 1:
            yield first, row + 1, pa.array(texts, pa.binary())
            texts, size, first = [], 0, row + 1


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists of 64-bit hashes."""
    if column.null_count == len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy().view(np.uint64)


def _is_listed(owner: np.ndarray, value: np.ndarray, row: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether (owner, value) is one of (row, listed)."""
    if not len(listed):
        return np.zeros(len(value), bool)
    hit = np.flatnonzero(np.isin(value, listed))
    pairs = set(zip(row.tolist(), listed.tolist()))
    out = np.zeros(len(value), bool)
    out[hit] = [p in pairs for p in zip(owner[hit].tolist(), value[hit].tolist())]
    return out


def repeated_spans(docs: DataFrame, finish, schema: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Apply ``finish`` to every document with the words that stand in an earlier one.

    ``finish(doc_ids, windows, covered)`` takes the ids of some rows, their
    :class:`Windows` and whether each word is covered by a window that also starts in a document
    with a smaller doc_id; it returns Arrow columns for ``schema``. Windows are judged
    on the input. Null texts have no words; rows with a null doc_id lose nothing
    and take nothing from others; rows with one doc_id are one document.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = (
        anchors(docs, window, anchor, with_paths=False)
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where(F.col("first_doc") < F.col("last_doc"))
        .select("anchor")
    )
    paths = kept(anchors(docs, window, anchor).join(known, "anchor"), "repeated-paths", release=True)
    first = paths.groupBy("anchor", "path").agg(F.min("doc_id").alias("first_doc"))
    branching = first.groupBy("anchor").agg(F.min("path").alias("p"), F.max("path").alias("q")).where(F.col("p") != F.col("q"))
    copies = (
        paths.join(first, ["anchor", "path"])
        .where(F.col("first_doc") < F.col("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("path").alias("paths"))  # paths of one document
    )
    apart = (
        first.join(branching.select("anchor"), "anchor")
        .groupBy(F.col("first_doc").alias("doc_id"))
        .agg(F.collect_list("path").alias("branching"))  # paths of one document
    )
    # Inner joins would ask for ids on their branch alone; rows without one come back at the end.
    packed = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_packed, "doc_id bigint, packed binary").where(F.col("doc_id").isNotNull())

    def branches(batches):
        for whole in batches:
            for first, end, texts in _unpacked(whole):
                ids = whole.column("doc_id").slice(first, end - first)
                windows = Windows(texts, window, anchor)
                owner = windows.owner[windows.at]
                hit = _is_listed(owner, windows.path_of_window(), *_lists(whole.column("branching").slice(first, end - first)))
                owner, a, w = _distinct_rows(owner[hit], windows.anchors[hit], windows.window_hashes()[hit])
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(w), ids.take(pa.array(owner))], names=["anchor", "window", "doc_id"])

    asked = packed.join(apart, "doc_id").mapInArrow(
        branches, "anchor bigint, window bigint, doc_id bigint"
    )
    earlier = (
        asked.groupBy("anchor", "window")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where(F.col("first_doc") < F.col("last_doc"))
        .drop("last_doc")
    )
    single = (
        asked.join(earlier, ["anchor", "window"])
        .where(F.col("first_doc") < F.col("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("window").alias("windows"))  # windows of one document
    )

    def finished(batches):
        for whole in batches:
            for first, end, texts in _unpacked(whole):
                rows = whole.slice(first, end - first)
                windows = Windows(texts, window, anchor)
                owner = windows.owner[windows.at]
                hit = _is_listed(owner, windows.path_of_window(), *_lists(rows.column("paths")))
                hit |= _is_listed(owner, windows.window_hashes(), *_lists(rows.column("windows")))
                out = pa.RecordBatch.from_arrays(finish(rows.column("doc_id"), windows, windows.covered(hit)), names=names)
                del windows, owner, hit  # before the next texts come
                yield out

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    together = packed.join(copies, "doc_id", "left").join(single, "doc_id", "left")
    unknown = docs.where(F.col("doc_id").isNull()).mapInArrow(_packed, "doc_id bigint, packed binary")
    nothing = F.array().cast("array<bigint>")
    unknown = unknown.withColumns({"paths": nothing, "windows": nothing})
    return together.unionByName(unknown).mapInArrow(finished, schema)


def _digest(doc_ids, windows: Windows, covered: np.ndarray):
    words = windows.words
    removed = np.concatenate(([0], np.cumsum(covered)))
    removed = removed[words.first[1:]] - removed[words.first[:-1]]
    sums = [hashlib.sha256(t).hexdigest() for t in _kept_texts(words, covered)]
    return [doc_ids, pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sums)]


def _kept_texts(words: Words, covered: np.ndarray) -> list[bytes]:
    """Kept words of each text joined by one space."""
    kept = np.flatnonzero(~covered)
    sizes = words.ends[kept] - words.starts[kept]
    out_ends = np.cumsum(sizes + 1)
    line = np.full(int(out_ends[-1]) if len(kept) else 0, 32, np.uint8)
    at = np.repeat(words.starts[kept] - (out_ends - sizes - 1), sizes)
    place = np.arange(sizes.sum()) + np.repeat(np.arange(len(kept)), sizes)
    line[place] = words.data[place + at]
    raw = line.tobytes()
    bounds = np.concatenate(([0], out_ends))[np.searchsorted(kept, words.first)].tolist()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``."""
    return repeated_spans(docs, _digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _texts(doc_ids, windows: Windows, covered: np.ndarray):
    return [doc_ids, pa.array([t.decode() for t in _kept_texts(windows.words, covered)])]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text: the kept words of every row, joined by one space."""
    return repeated_spans(docs, _texts, "doc_id bigint, text string")
