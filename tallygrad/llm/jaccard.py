"""Documents whose sets of word shingles have a high Jaccard similarity, and the groups they form.

Documents with equal sets are one class. Every
class orders its shingles from rare to frequent by estimated counts and indexes
a prefix of them. A longer prefix that requires more shared shingles costs
more index entries and yields fewer candidates, so each class picks its own
number of required matches by the estimated cost; a pair has to share the
smaller number of the two, and their signatures, parities of shingles by hash,
may differ in no more bits than similar sets differ in shingles. Candidates are
verified on their whole sets.

Groups are wanted, not all pairs. So every class is first compared with the
smallest class of each of its index entries, which connects copies in as many
comparisons as there are copies; after that only entries that still hold
different groups yield candidates, and only between groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.components import connected_components
from tallygrad.llm.store import kept
from tallygrad.llm.text import Words, pieces, shingle_sets

#: Bytes of text worked on at once.
STEP_BYTES = 512 << 10
#: Shingles of the sets a verifying task remembers.
CACHE_SHINGLES = 1 << 20
#: Counters of the frequency estimate, in how many rows a task hands them over, and tasks summed up at first.
COUNTERS, CHUNKS, FAN_IN = 1 << 20, 16, 32
#: Most matches a prefix may require, cost of a verification in index entries, documents that share a shingle by
#: chance besides those estimated, and share of the chance candidates that each further match leaves.
MOST_MATCHES, VERIFY_COST, BY_CHANCE, LEFT = 8, 500, 0.3, 1 / 8
MATCH_BITS = 4
#: Hubs of an index entry.
HUBS = 4
#: 64-bit words of a set's signature, and their columns.
SIGNATURE = 8
SIGNS = [f"sign{i}" for i in range(SIGNATURE)]


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of each text, shingles) of lower-cased texts; each text's are sorted."""
    words = Words(column, lower=True)
    owner, shingles = shingle_sets(words, words.hashes(), k)
    return np.searchsorted(owner, np.arange(len(column) + 1)), shingles


def _keys(first: np.ndarray, shingles: np.ndarray) -> list[bytes | None]:
    """Digest of each set, none for an empty one."""
    raw, at = shingles.tobytes(), (8 * first).tolist()
    return [hashlib.md5(raw[a:b]).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]


def signatures(first: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(texts, SIGNATURE) words of 64 bits; a bit tells whether an odd number of a set's shingles falls on it.

    Shingles that two sets share cancel out, so their signatures differ in no
    more bits than the sets differ in shingles.
    """
    n, bits = len(first) - 1, 64 * SIGNATURE
    owner = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(owner * bits + (shingles % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def shingle_keys(docs: DataFrame, k: int, with_text: bool) -> DataFrame:
    """(doc_id, n_shingles, key): size of the set and a digest of it, null for an empty one; then its signature or its packed text."""

    def found(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in pieces(whole, size=STEP_BYTES):
                first, shingles = _sets(batch.column("text"), k)
                keys = pa.array(_keys(first, shingles), pa.binary())
                out = [batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), keys]
                if with_text:
                    texts = batch.column("text").to_pylist()
                    out.append(pa.array([None if t is None else pack(t.encode()) for t in texts], pa.binary()))
                else:
                    out += [pa.array(column) for column in np.ascontiguousarray(signatures(first, shingles).T)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_shingles", "key", *more])

    more = ["packed"] if with_text else SIGNS
    schema = "doc_id bigint, n_shingles bigint, key binary, " + ", ".join(f"{c} {'binary' if with_text else 'bigint'}" for c in more)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(found, schema)


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True) >> MATCH_BITS << MATCH_BITS


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


def estimated_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Counters over the shingles of all documents; the estimate of a shingle's count is its counter.

    Their number is fixed, so the sum is of bounded size whatever the input; they
    steer the order of shingles and the cost, never the result.
    """

    def counted(batches):
        total = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in pieces(whole, size=STEP_BYTES):
                total += np.bincount(_counter(_sets(batch.column("text"), k)[1]), minlength=COUNTERS)
        if total.any():
            parts = total.astype(np.uint32).reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array([zstandard.compress(p.tobytes()) for p in parts], pa.binary())],
                names=["chunk", "counts"],
            )

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(c.as_py()), np.uint32).astype(np.int64) for c in table.column("counts"))
        packed = zstandard.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes())
        return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "counts": pa.array([packed], pa.binary())})

    parts = docs.select("text").mapInArrow(counted, "chunk int, counts binary")
    parts = parts.withColumn("some", (F.spark_partition_id() / FAN_IN).cast("int"))
    parts = parts.groupBy("chunk", "some").applyInArrow(summed, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInArrow(summed, "chunk int, counts binary").collect()  # CHUNKS rows
    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint32)
    for row in rows:
        out[row.chunk] = np.frombuffer(zstandard.decompress(row.counts), np.uint32)
    return out.ravel()


def matches_and_prefix(estimates: np.ndarray, percent: int) -> tuple[int, int]:
    """(matches to require, length of the prefix) for a set whose estimated counts are given in ascending order."""
    n = len(estimates)
    least = -(-percent * n // 100)  # shingles shared with any similar set
    most = min(MOST_MATCHES, least)
    lengths = n - least + np.arange(1, most + 1)
    candidates = np.cumsum(estimates + BY_CHANCE)[lengths - 1] * LEFT ** np.arange(most)
    cost = lengths + VERIFY_COST * candidates
    m = int(cost.argmin())
    return m + 1, int(lengths[m])


def prefixes(docs: DataFrame, counts, k: int, percent: int) -> DataFrame:
    """(shingle, node): the index entries of each document. ``counts`` is a broadcast of the estimates.

    ``node`` is the first half of the digest of the set with the matches it requires in
    its last ``MATCH_BITS`` bits, so equal sets give equal entries and entries stay short.
    """

    def indexed(batches):
        estimate = counts.value
        usual = int(estimate.mean())  # what other shingles add to a counter
        for whole in batches:
            for batch in pieces(whole, size=STEP_BYTES):
                first, shingles = _sets(batch.column("text"), k)
                nodes = np.array([_node(key) if key else 0 for key in _keys(first, shingles)], np.int64)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
                counter = estimate[_counter(shingles)]
                order = np.lexsort((shingles, counter, owner))
                shingles, excess = shingles[order], np.maximum(counter[order].astype(np.int64) - usual, 0)
                taken, matches = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
                for t in np.flatnonzero(np.diff(first)).tolist():
                    matches[t], taken[t] = matches_and_prefix(excess[first[t] : first[t + 1]], percent)
                index = np.repeat(first[:-1] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shingles[index].view(np.int64)),
                        pa.array(np.repeat(nodes + matches, taken)),
                    ],
                    names=["shingle", "node"],
                )

    return docs.select("text").mapInArrow(indexed, "shingle bigint, node bigint")


def similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, judged on the whole sets."""

    def verified(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        sets: dict[bytes, np.ndarray] = {}
        size = 0

        def set_of(text: bytes) -> np.ndarray:
            nonlocal size
            if text not in sets:
                if size > CACHE_SHINGLES:
                    sets.clear()
                    size = 0
                sets[text] = _sets(pa.array([unpack(text)], pa.binary()), k)[1]
                size += len(sets[text])
            return sets[text]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                a, b = set_of(x.as_py()), set_of(y.as_py())
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("doc").alias("a"), F.col("packed").alias("left"))
    two = texts.select(F.col("doc").alias("b"), F.col("packed").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(verified, "a bigint, b bigint")


def _sizes_fit(percent: int):
    return 100 * F.least("n", "other_n").cast("bigint") >= percent * F.greatest("n", "other_n").cast("bigint")


def _signs_fit(percent: int):
    """A similar pair differs in at most (100 - percent) / (100 + percent) of both sizes, so its signatures do."""
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in SIGNS), F.lit(0))
    sizes = F.col("n").cast("bigint") + F.col("other_n").cast("bigint")
    return bits * (100 + percent) <= sizes * (100 - percent)


def _shared_needed(percent: int):
    """Entries that a similar pair shares at least.

    All it shares beyond its common entries lies behind the prefix of one of
    the two, and altogether it shares percent / (100 + percent) of both sizes.
    """
    n, other = F.col("n").cast("bigint"), F.col("other_n").cast("bigint")
    behind = [F.ceil(percent * size / 100) - F.col(m) for size, m in ((n, "matches"), (other, "other_matches"))]
    overlap = F.ceil((percent * (n + other)) / F.lit(100 + percent) - F.lit(1e-9))
    return F.greatest(F.least("matches", "other_matches").cast("bigint"), overlap - F.greatest(*behind))


def similar_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Words are split at ASCII white space and A-Z lower-cased; a text of fewer
    than ``k`` words has its whole sequence as its one shingle. Null texts and
    texts without words have no shingles and link with nothing; a null doc_id
    links nothing and keeps a null component. Rows with one doc_id count as one
    document. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    counts = docs.sparkSession.sparkContext.broadcast(estimated_counts(known, k))  # 4 MB
    entries = prefixes(known, counts, k, percent)
    repeated = (
        entries.groupBy("shingle").agg(F.min("node").alias("p"), F.max("node").alias("q")).where(F.col("p") < F.col("q")).select("shingle")
    )
    shared = kept(entries.join(repeated, "shingle").distinct(), "shingle-entries", release=True)
    low = F.lit((1 << MATCH_BITS) - 1)
    shared = shared.select("shingle", F.col("node").bitwiseAND(F.bitwise_not(low)).alias("node"), F.col("node").bitwiseAND(low).cast("int").alias("matches"))
    # Only classes that hold enough repeated entries can have a partner.
    asked = shared.groupBy("shingle").agg(F.min("matches").alias("least"))
    nodes = (
        shared.join(asked, "shingle")
        .groupBy("node")
        .agg(F.count("*").alias("entries"), F.min(F.least("matches", "least")).alias("needed"))
        .where(F.col("entries") >= F.col("needed"))
        .select("node")
    )
    rows = shingle_keys(docs, k, with_text=False)
    classes = (
        rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").cast("int").alias("n"), *(F.first(c).alias(c) for c in SIGNS))
    )
    classes = kept(classes, "shingle-classes")
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint").bitwiseAND(F.bitwise_not(low))
    wanted = kept(classes.withColumn("node", node).join(nodes, "node"), "shingle-wanted")
    packed = (
        shingle_keys(known, k, with_text=True).where(F.col("key").isNotNull()).groupBy("key").agg(F.first("packed").alias("packed"))
    )
    texts = kept(packed.join(wanted.select("key", "doc"), "key").select("doc", "packed"), "shingle-texts", release=True)
    index = kept(shared.join(wanted.select("node", "doc", "n"), "node").drop("node"), "shingle-index", release=True)

    # Each entry has hubs, the smallest class and the smallest by some hashes; each class meets, of each kind, the hub
    # it shares most entries with. Copies of one text have the same hubs, so a copy that is too far from one hub
    # meets others before it is compared at large.
    ranks = [F.col("doc"), *(F.xxhash64("doc", F.lit(i)) for i in range(1, HUBS))]
    smallest = [F.min(F.struct(rank.alias("rank"), "doc", "n", "matches")).alias(f"hub{i}") for i, rank in enumerate(ranks)]
    hub = index.groupBy("shingle").agg(*smallest)
    with_hub = index.join(hub, "shingle").select("doc", "n", F.posexplode(F.array(*(f"hub{i}" for i in range(HUBS)))).alias("kind", "hub"))
    hubs = (
        with_hub.select("doc", "n", "kind", F.col("hub.doc").alias("other_doc"), F.col("hub.n").alias("other_n"))
        .where((F.col("doc") != F.col("other_doc")) & _sizes_fit(percent))
        .groupBy("doc", "kind", "other_doc")
        .agg(F.count("*").alias("entries"))
        .groupBy("doc", "kind")
        .agg(F.max_by("other_doc", "entries").alias("b"), F.max("entries").alias("entries"))
        .where(F.col("entries") > 1)
        .select(F.greatest("doc", "b").alias("a"), F.least("doc", "b").alias("b"))
        .distinct()
    )
    links = kept(similar(hubs, texts, k, percent), "shingle-links", release=True)
    groups = connected_components(links)

    grouped = index.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("group", F.coalesce("component", "doc"))
    grouped = grouped.select("shingle", "doc", "n", "matches", "group")
    mixed_entries = (
        grouped.groupBy("shingle").agg(F.min("group").alias("p"), F.max("group").alias("q")).where(F.col("p") < F.col("q")).select("shingle")
    )
    open_entries = grouped.join(mixed_entries, "shingle").join(wanted.select("doc", *SIGNS), "doc")
    open_entries = kept(open_entries, "shingle-open", release=True)
    other = open_entries.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("doc", "n", "matches", "group", *SIGNS)))
    # Copies of one text that are too far apart share many entries; their signatures tell inside the join.
    candidates = (
        open_entries.join(other, "shingle")
        .where((F.col("group") < F.col("other_group")) & _sizes_fit(percent) & _signs_fit(percent))
        .groupBy(F.col("doc").alias("a"), F.col("other_doc").alias("b"))
        .agg(F.count("*").alias("shared"), F.first(_shared_needed(percent)).alias("needed"))
        .where(F.col("shared") >= F.col("needed"))
        .select("a", "b")
    )
    more = similar(candidates, texts, k, percent)
    groups = connected_components(links.union(more))

    of_class = (
        classes.select("key", "doc")
        .join(groups.withColumnRenamed("node", "doc"), "doc", "left")
        .select("key", F.coalesce("component", "doc").alias("component_id"))
    )
    return rows.join(of_class, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
