"""A manifest of a dataset: hash trees over rows, one per source, and a tree over the sources.

Every row is a leaf. In each source's tree, rows ordered by key, every three
nodes in a row have one parent, the SHA-256 of their hex digests; the trees'
roots, ordered by source, are joined in the same way into one root. A parent
keeps the state of its hash before each child slot, so folding a changed leaf
resumes the states on its path with the new digest and the siblings to the
right, and reads nothing to the left.

Spark numbers the leaves with a range sort (a large source is spread over many
ranges) and works on blocks of 729 neighbouring nodes, six levels at a time;
blocks of all trees are dealt out together, so no task and no group grows with a
source. On the way up each block gives one node; on the way down it gets the
states and siblings above it as one row and hands them on to its nodes. The
driver learns the size of the largest tree and nothing else.

Defined results: a null counts as ``-`` in a leaf; null sources come first and
form a tree; rows with the same key are ordered by their leaf, rows alike in all
columns have the same leaf and places of their own; an empty table has no rows
and no root; columns that are not named stay out of the leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrad.llm import sha256
from tallygrad.llm.store import kept

FAN = 3
#: Levels worked on at once, and the nodes below a block's root.
LEVELS = 6
BLOCK = FAN**LEVELS
#: Nodes that are hashed together; more than one block.
TOGETHER = 12 * BLOCK

#: What a node's parent keeps for it: its slot, how many children there are, the state before the slot, all children.
STEP = np.dtype([("slot", "u1"), ("children", "u1"), ("state", "<u4", 8), ("digests", "u1", (FAN, 32))])

_NODE = "tree string, place bigint, n bigint, digest binary"
_ABOVE = "tree string, place bigint, path binary, subroot binary, root binary"


def _field(value) -> bytes:
    if value is None:
        return b"-"
    text = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%s" % (len(text), text)


def leaves(docs: DataFrame, columns: Sequence[str], tree: str, key: str, changed: Column | None = None) -> DataFrame:
    """(tree, key, digest, other) of every row: its leaf, and the leaf with ``changed`` as last column where that isn't null.

    The last column is the long one; the hash of the others is begun once for both.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        *[F.col(c).cast("string").alias(f"part{i}") for i, c in enumerate(columns)],
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    last = len(columns) - 1

    def hashed(batches):
        for batch in batches:
            parts = [batch.column(f"part{i}").to_pylist() for i in range(last)]
            digests, others = [], []
            for at, (text, new) in enumerate(zip(batch.column(f"part{last}"), batch.column("changed"))):
                head = hashlib.sha256(b"".join(_field(p[at]) for p in parts))
                if new.is_valid:
                    other = head.copy()
                    other.update(_field(new.as_py()))
                    others.append(other.digest())
                else:
                    others.append(None)
                head.update(_field(text.as_py()))
                digests.append(head.digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("key"), pa.array(digests, pa.binary()), pa.array(others, pa.binary())],
                names=["tree", "key", "digest", "other"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"tree string, key {kind}, digest binary, other binary")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of each ``tree`` with their ``place`` from 0 in the given order, and their count ``n``, as a written table.

    A range sort by tree and order; the first place of each range comes from a
    count per range and tree, so that a tree may be of any size.
    """
    sort = ["tree", *order]
    ordered = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = kept(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")
    )
    placed = ordered.join(starts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    return kept(placed.drop("at", "part", "shift"), "numbered")


def _by_block(rows: DataFrame) -> DataFrame:
    """Whole blocks in one partition each, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("bigint"))


def _first_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of each block."""
    if batch.num_rows == 0:
        return np.zeros(0, np.int64)
    tree, block = batch.column("tree"), batch.column("block").to_numpy()
    differs = pc.not_equal(tree.slice(1), tree.slice(0, len(tree) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], 1 + np.flatnonzero(differs | (block[1:] != block[:-1]))))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least TOGETHER rows, the last one excepted, cut between blocks."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        joined = pa.concat_batches(held)
        cut = int(_first_rows(joined)[-1])
        if cut:
            yield joined.slice(0, cut)
        held, rows = [joined.slice(cut)], joined.num_rows - cut
    if rows:
        yield pa.concat_batches(held)


def _bytes(column: pa.Array) -> np.ndarray:
    """(rows, 32) bytes of a column of digests without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


class Climb:
    """Blocks of nodes hashed up to their roots; ``steps[k]`` holds what parents keep for the nodes of level k."""

    def __init__(self, block: np.ndarray, place: np.ndarray, n: np.ndarray, digest: np.ndarray):
        self.steps: list[np.ndarray] = []
        #: Row of each node's parent among the nodes of the next level.
        self.parent: list[np.ndarray] = []
        #: False where a tree has one node left at this level, which has no parent.
        self.joined: list[np.ndarray] = []
        for _ in range(LEVELS):
            joined = n > 1
            slot = np.where(joined, place % FAN, 0)
            first = np.ones(len(place), bool)
            first[1:] = (block[1:] != block[:-1]) | (place[1:] // FAN != place[:-1] // FAN)
            parent = np.cumsum(first) - 1
            step = np.zeros(len(place), STEP)
            step["slot"], step["children"] = slot, np.bincount(parent, minlength=int(first.sum()))[parent]
            top = np.flatnonzero(first)
            states = sha256.started(len(top))
            family = np.zeros((len(top), FAN, 32), np.uint8)
            for s in range(FAN):
                rows = np.flatnonzero(joined & (slot == s))
                at = parent[rows]
                step["state"][rows] = states[at]
                if len(rows):
                    states[at] = sha256.compress(states[at], sha256.hex_block(digest[rows]))
                family[at, s] = digest[rows]
            step["digests"] = family[parent]
            above = digest[top].copy()
            hashed = joined[top]
            above[hashed] = sha256.finished(states[hashed], step["children"][top][hashed])
            self.steps.append(step)
            self.parent.append(parent)
            self.joined.append(joined)
            block, place, digest = block[top], np.where(hashed, place[top] // FAN, place[top]), above
            n = np.where(hashed, -(-n[top] // FAN), n[top])
        #: Row of each node's block among the blocks, their digests, places and counts at the level above.
        self.digest, self.place, self.n = digest, place, n

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For level after level, the step of every first node's ancestor and whether it has a parent there."""
        at = np.arange(len(self.parent[0]))
        for step, parent, joined in zip(self.steps, self.parent, self.joined):
            yield step[at], joined[at]
            at = parent[at]


def _climbed(batch: pa.RecordBatch, first: np.ndarray) -> Climb:
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
    place, n = batch.column("place").to_numpy(), batch.column("n").to_numpy()
    return Climb(block, place, n, _bytes(batch.column("digest")))


def climb(nodes: DataFrame) -> DataFrame:
    """Six levels up: one node for each block of (tree, place, n, digest)."""

    def up(batches):
        for batch in _whole_blocks(batches):
            first = _first_rows(batch)
            found = _climbed(batch, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree").take(pa.array(first)), pa.array(found.place), pa.array(found.n), _binary(found.digest)],
                names=["tree", "place", "n", "digest"],
            )

    return _by_block(_with_block(nodes.select("tree", "place", "n", "digest"))).mapInArrow(up, _NODE)


def _together(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes and, first in each block, the row with what lies above it."""
    top = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("bigint").alias("place"), "path", "subroot", "root")
    return _by_block(_with_block(nodes).unionByName(top, allowMissingColumns=True))


def _parted(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray, Climb]:
    """Nodes, the rows above their blocks, each node's block and the climb."""
    is_top = batch.column("place").to_numpy() < 0
    tops, nodes = batch.filter(pa.array(is_top)), batch.filter(pa.array(~is_top))
    first = _first_rows(nodes)
    if len(first) != tops.num_rows:
        raise ValueError("a block has no row above it")
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, nodes.num_rows)))
    return nodes, tops, block, _climbed(nodes, first)


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """What lies above every node of a level, from what lies above their blocks: (tree, place, path, subroot, root)."""

    def down(batches):
        for batch in _whole_blocks(batches):
            nodes, tops, block, found = _parted(batch)
            higher = tops.column("path").to_pylist()
            levels = list(found.levels())
            paths = [
                b"".join(step[i].tobytes() for step, joined in levels if joined[i]) + higher[b] for i, b in enumerate(block)
            ]
            at = pa.array(block)
            yield pa.RecordBatch.from_arrays(
                [nodes.column("tree"), nodes.column("place"), pa.array(paths, pa.binary()),
                 tops.column("subroot").take(at), tops.column("root").take(at)],
                names=["tree", "place", "path", "subroot", "root"],
            )

    return _together(nodes.select("tree", "place", "n", "digest"), above).mapInArrow(down, _ABOVE)


def fold(digest: np.ndarray, levels) -> np.ndarray:
    """Roots that follow from replaced nodes: the kept state of each step, the new digest, the siblings to the right.

    ``levels`` gives (steps, joined) per level, one row per node; a node that isn't joined stays as it is.
    """
    digest = digest.copy()
    for step, joined in levels:
        rows = np.flatnonzero(joined)
        state = sha256.compress(step["state"][rows].astype(np.uint32), sha256.hex_block(digest[rows])) if len(rows) else None
        for s in range(1, FAN):
            right = np.flatnonzero((step["slot"][rows] < s) & (s < step["children"][rows]))
            if len(right):
                state[right] = sha256.compress(state[right], sha256.hex_block(step["digests"][rows[right], s]))
        if len(rows):
            digest[rows] = sha256.finished(state, step["children"][rows])
    return digest


def proof_digests(n: int, levels) -> np.ndarray:
    """SHA-256 of the hex digests of all siblings on the paths of n nodes, level by level, left to right."""
    state, blocks = sha256.started(n), np.zeros(n, np.int64)
    for step, joined in levels:
        for s in range(FAN):
            rows = np.flatnonzero(joined & (step["slot"] != s) & (s < step["children"]))
            if len(rows):
                state[rows] = sha256.compress(state[rows], sha256.hex_block(step["digests"][rows, s]))
                blocks[rows] += 1
    return sha256.finished(state, blocks)


def _all_levels(found: Climb, tops: pa.RecordBatch, block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels inside the blocks, then those of the rows above them; paths of several lengths end early."""
    levels = list(found.levels())
    paths = [np.frombuffer(p, STEP) for p in tops.column("path").to_pylist()]
    for k in range(max(map(len, paths), default=0)):
        there = np.array([k < len(p) for p in paths])
        steps = np.zeros(len(paths), STEP)
        for b in np.flatnonzero(there):
            steps[b] = paths[b][k]
        levels.append((steps[block], there[block]))
    return levels


@dataclass
class Manifest:
    """Numbered leaves, the nodes of every sixth level between them and the trees' roots, and what lies above these roots."""

    #: (tree, key, place, n, digest, other)
    leaves: DataFrame
    rounds: list[DataFrame]
    #: (tree, place, path, subroot, root), one row per tree
    tops: DataFrame

    def proofs(self) -> DataFrame:
        """Every leaf with its tree's root, the root, the hash of its siblings, and what its ``other`` leaf folds to.

        (tree, key, place, leaf, subroot, root, proof, folded), digests as hex. A leaf
        without ``other`` is folded as it is.
        """
        above = self.tops
        for nodes in reversed(self.rounds):
            above = kept(descend(nodes, above), "above")

        def proven(batches):
            for batch in _whole_blocks(batches):
                nodes, tops, block, found = _parted(batch)
                levels = _all_levels(found, tops, block)
                leaf = nodes.column("digest")
                folded = fold(_bytes(pc.coalesce(nodes.column("other"), leaf)), levels)
                at = pa.array(block)
                digests = [leaf, tops.column("subroot").take(at), tops.column("root").take(at),
                           _binary(proof_digests(len(block), levels)), _binary(folded)]
                yield pa.RecordBatch.from_arrays(
                    [*(nodes.column(c) for c in ("tree", "key", "place")),
                     *(pa.array([d.hex() for d in column.to_pylist()], pa.string()) for column in digests)],
                    names=["tree", "key", "place", "leaf", "subroot", "root", "proof", "folded"],
                )

        kind = self.leaves.schema["key"].dataType.simpleString()
        schema = f"tree string, key {kind}, place bigint, leaf string, subroot string, root string, proof string, folded string"
        return _together(self.leaves, above).mapInArrow(proven, schema)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every sixth level from the given ones on, until each tree has one left."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    found = [nodes]
    while largest > 1:
        found.append(kept(climb(found[-1]), "nodes"))
        largest = -(-largest // BLOCK)
    return found


def build(docs: DataFrame, columns: Sequence[str], tree: str, key: str, changed: Column | None = None) -> Manifest:
    """The manifest of a table: leaves over ``columns``, ordered by ``key`` in a tree for each value of ``tree``."""
    # Written first, since a range sort reads its input twice.
    rows = numbered(kept(leaves(docs, columns, tree, key, changed), "leaves"), ["key", "digest"])
    levels = _rounds(rows)
    # One tree over the trees' roots; the order of the names is that of the sources.
    names = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = _rounds(numbered(names, ["name"]))
    root = forest[-1].select(
        "tree", "place", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")
    )
    for nodes in reversed(forest[:-1]):
        root = kept(descend(nodes, root), "above")
    # A source's row above is what lies above its root; the root's digest is the source's own.
    tops = forest[0].join(root.select("place", "path", "root"), "place").select(
        F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", F.col("digest").alias("subroot"), "root"
    )
    return Manifest(rows, levels[1:-1], kept(tops, "tops"))


#: Columns of a leaf of ``documents``; the text comes last.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_text() -> Column:
    """The text without line feeds where 2 divides the crc32 of the id; null where nothing is taken out."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen & F.contains("text", F.lit("\n")), F.translate("text", "\n", ""))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, some of them tampered with."""
    found = build(docs, LEAF_COLUMNS, "source", "doc_id", tampered_text()).proofs()
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
