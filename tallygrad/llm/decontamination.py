"""Copies of test items in training text, edited ones too.

A Smith-Waterman alignment of a passage and an item scores the pair. A pair that
reaches the threshold must share pairs of words that stand side by side or one
word apart, and how many follows from the threshold: an alignment of ``e`` equal
words is worth ``EQUAL`` and, for each step from one equal word to the next,
``EQUAL`` less what the step costs. Only steps that cost 0 or 1 add anything, and
those are such pairs: side by side in both for 2 points, at most one word apart
in both for 1 point. So ``points - EQUAL`` bounds from below what the pairs at
different places of the item are worth, and from above how many words of a
document the alignment takes. Nothing else decides what is aligned.

One pass over the documents gives only passages that hold enough pairs of items;
whole texts are never shuffled. Words are runs of ASCII letters and digits and of
other than ASCII characters, in lower case. A filter whose size follows from the
benchmark, within bounds, keeps most other pairs from leaving the scan. Of the
pairs of an item only rare ones are seeds: its most frequent places are left out
as far as an alignment could do without all of them, so every pair that reaches
the threshold meets at a rare seed, and common pairs of words join nothing.

Items of one or two words are found where they stand whole: one equal word of
two would reach the threshold in most documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallygrad.llm.store import kept
from tallygrad.llm.text import Words, mixed, pieces

#: Points for an equal word, another word and a gap, and the share of the points of a full copy that counts as a leak.
EQUAL, OTHER, GAP, THRESHOLD = 2, -1, -1, 0.4
#: Words of the smallest item that edited copies are looked for; shorter ones count where they stand whole.
LEAST_WORDS = 3
#: Least and most bits of the filter's slots; 14 bytes a slot in each task.
FILTER_BITS = 16, 22

_split = np.ones(256, dtype=bool)
_split[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(column, _split, lower=True)
    return words, words.hashes()


def _pairs(hashes: np.ndarray, owner: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all pairs of words ``apart`` words from each other that lie within one text."""
    n = max(0, len(hashes) - apart)
    at = np.flatnonzero(owner[:n] == owner[apart:][:n])
    with np.errstate(over="ignore"):
        return at, mixed(hashes[at] * np.uint64(0xD1342543DE82EF95) + hashes[at + apart])


def filter_bits(pairs: int) -> int:
    """Bits of a filter in which ``pairs`` pairs fill a sixteenth of the slots, as far as the bounds let them."""
    return min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * pairs - 1).bit_length()))


def _serial():
    """Numbers that no other task gives."""
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1


def bounds_of(size: int, threshold: float) -> tuple[int, int]:
    """(least worth of the pairs, most words of a document) of an alignment with an item of ``size`` words that reaches the threshold."""
    if size < LEAST_WORDS:
        return size, size  # its word, or its two words side by side
    points = int(np.ceil(threshold * EQUAL * size - 1e-9))
    return max(1, points - EQUAL), max(size, (EQUAL + 1) * size - points)


def item_pairs(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, item_id, words, needed, span, near, apart): the pairs of each item in order, side by side and one word
    apart, what they must be worth and how many words a copy takes. An item of one word has that in place of a pair; items
    without words are left out. A repeated item_id counts as items of their own with one id."""

    def split(batches):
        serial = _serial()
        for whole in batches:
            for batch in pieces(whole):
                words, hashes = _words(batch.column("text"))
                owner, first = words.owner(), words.first
                (a, near), (b, apart) = _pairs(hashes, owner, 1), _pairs(hashes, owner, 2)
                rows = [i for i, n in enumerate(words.counts.tolist()) if n]
                within = lambda at, g, i: g[slice(*np.searchsorted(at, first[i : i + 2]))].view(np.int64)
                one = lambda i: mixed(hashes[first[i] : first[i] + 1]).view(np.int64)
                bounds = [bounds_of(int(words.counts[i]), threshold) for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(serial) for _ in rows], pa.int64()),
                        batch.column("item_id").take(pa.array(rows, pa.int64())),
                        pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary()),
                        pa.array([x for x, _ in bounds], pa.int64()),
                        pa.array([x for _, x in bounds], pa.int64()),
                        pa.array([within(a, near, i) if words.counts[i] > 1 else one(i) for i in rows], pa.list_(pa.int64())),
                        pa.array([within(b, apart, i) for i in rows], pa.list_(pa.int64())),
                    ],
                    names=["item", "item_id", "words", "needed", "span", "near", "apart"],
                )

    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(
        split,
        "item bigint, item_id bigint, words binary, needed bigint, span bigint, near array<bigint>, apart array<bigint>",
    )


def item_seeds(pairs_of_items: DataFrame) -> DataFrame:
    """(gram, item, needed, span, place, near): one row per pair of an item."""

    def of(column: str, near: bool) -> DataFrame:
        return pairs_of_items.select("item", "needed", "span", F.lit(near).alias("near"), F.posexplode(column).alias("place", "gram"))

    return of("near", True).unionByName(of("apart", False))


def _filter(seeds: DataFrame) -> tuple[np.ndarray, ...]:
    """The filter's bits, leading bits of hashes that occur, with the least need and most words of their items, whether a
    pair side by side is among them, and which of 64 groups of items have one. The bits follow from the number of
    pairs, within bounds, so at most 2**22 slots reach the driver."""
    bits = filter_bits(seeds.count())
    found = (
        seeds.groupBy(F.shiftrightunsigned("gram", 64 - bits).alias("slot"))
        .agg(
            F.min("needed").alias("needed"),
            F.max("span").alias("span"),
            F.max("near").alias("near"),
            F.expr("bit_or(shiftleft(1L, CAST(pmod(xxhash64(item), 64) AS INT)))").alias("groups"),
        )
        .toArrow()
    )
    slots, needed, span, near, groups = (found.column(i).to_numpy() for i in range(5))
    small = np.minimum(needed, 255).astype(np.uint8)
    return bits, slots.astype(np.int32), small, span.astype(np.int32), near.astype(bool), groups.astype(np.int64)


class _Held:
    """The filter laid out by slot: need 0 where nothing occurs."""

    def __init__(self, bits: int, slots: np.ndarray, *values: np.ndarray):
        self.bits = bits
        self.needed, self.span, self.near, self.groups = laid = [np.zeros(1 << bits, v.dtype) for v in values]
        for out, value in zip(laid, values):
            out[slots] = value

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, hashes: np.ndarray, owner: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of the pairs that may be some item's; of single words if 0 apart."""
        at, g = _pairs(hashes, owner, apart) if apart else (np.arange(len(hashes)), mixed(hashes))
        hit = np.flatnonzero(self.needed[self.slot(g)])
        return at[hit], g[hit]


def _dense(words: Words, hashes: np.ndarray, held: _Held, single: bool):
    """The pairs of a batch around which enough pairs of one group of items stand: (word, hash) side by side, (word,
    hash) one word apart, and (word, first and end of the words around) of both. ``single`` words go with the latter."""
    owner = words.owner()
    (a, near), (b, apart) = held.hits(hashes, owner, 1), held.hits(hashes, owner, 2)
    if single:
        b, apart = map(np.concatenate, zip((b, apart), held.hits(hashes, owner, 0)))
    beside = np.repeat((True, False), (len(a), len(b)))
    place, gram = np.concatenate((a, b)), np.concatenate((near, apart))
    worth = 1 + (held.near[held.slot(gram)] & beside)
    order = np.lexsort((-worth, place))
    beside, place, gram, worth = beside[order], place[order], gram[order], worth[order]
    slot = held.slot(gram)
    row = owner[place]
    spans, needs = held.span[slot].astype(np.int64), held.needed[slot]
    low, high = np.maximum(words.first[row], place - spans), np.minimum(words.first[row + 1], place + spans + 3)
    bits = np.unpackbits(held.groups[slot].view(np.uint8).reshape(-1, 8), axis=1)
    group, pair = np.nonzero(np.ascontiguousarray(bits.T))  # in order of groups, then words
    for _ in range(4):  # pairs that can't be part of a copy count for no other
        at, base = place[pair], group * (len(words) + 1)  # each group counts on its own
        key = base + at
        # A word starts at most one step of an alignment: the better of its pairs counts, the first.
        counts = np.where(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])), worth[pair], 0)
        total = np.concatenate(([0], np.cumsum(counts)))
        around = total[np.searchsorted(key, base + high[pair])] - total[np.searchsorted(key, base + low[pair])]
        left = around >= needs[pair]
        if left.all():
            break
        group, pair = group[left], pair[left]
    pair = np.unique(pair)
    beside, place, gram = beside[pair], place[pair], gram[pair]
    return (place[beside], gram[beside]), (place[~beside], gram[~beside]), (place, low[pair], high[pair])


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, doc_id, from_word, passage, near, apart): stretches of documents that hold enough pairs of items to be
    a copy, with all words the alignment may take, and the distinct pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    single = not seeds.where(F.col("span") == 1).isEmpty()

    def found(batches):
        held, serial = _Held(*shared.value), _serial()
        for whole in batches:
            for batch in pieces(whole):
                words, hashes = _words(batch.column("text"))
                (a, near), (b, apart), (at, low, high) = _dense(words, hashes, held, single)
                keys, rows, starts, texts, lists = [], [], [], [], ([], [])
                if len(at):
                    # Stretches that overlap are one passage; texts never overlap.
                    ends, begins = np.maximum.accumulate(high), np.minimum.accumulate(low[::-1])[::-1]
                    cut = np.flatnonzero(begins[1:] >= ends[:-1]) + 1
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                        keys.append(next(serial))
                        rows.append(int(owner[i]))
                        starts.append(int(begins[i] - words.first[owner[i]]))
                        texts.append(hashes[begins[i] : ends[j - 1]].tobytes())
                        for some, (place, g) in zip(lists, ((a, near), (b, apart))):
                            inside = slice(*np.searchsorted(place, [at[i], at[j - 1] + 1]))
                            some.append(np.unique(g[inside]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(texts, pa.binary()),
                        *(pa.array(some, pa.list_(pa.int64())) for some in lists),
                    ],
                    names=["key", "doc_id", "from_word", "passage", "near", "apart"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        found, "key bigint, doc_id bigint, from_word bigint, passage binary, near array<bigint>, apart array<bigint>"
    )


def rare_seeds(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(gram, item): of each item, the rarest places whose pairs no alignment can do without.

    The pairs at a place are worth 2 at most, or 1 where only a pair one word apart
    stands. The most frequent places are left out as long as all that is left out is
    worth less than an alignment needs, so a passage that reaches the threshold
    holds a pair of another place. Frequency is that in the passages.
    """
    grams = found.select(F.explode(F.concat("near", "apart")).alias("gram"))
    counts = seeds.select("gram").distinct().join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    counted = seeds.join(counts, "gram", "left")
    places = counted.groupBy("item", "place", "needed").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max(F.when(F.col("near"), 2).otherwise(1)).alias("worth")
    )
    first = Window.partitionBy("item").orderBy(F.desc("n"), "place")  # as many rows as an item has words
    rare = places.withColumn("out", F.sum("worth").over(first)).where(F.col("out") >= F.col("needed"))
    return seeds.join(rare.select("item", "place"), ["item", "place"]).select("gram", "item").distinct()


def candidates(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, item): passages and items with a rare seed in common; their other pairs are counted where both are at hand."""
    grams = found.select("key", F.explode(F.concat("near", "apart")).alias("gram"))
    return grams.join(rare_seeds(found, seeds), "gram").select("key", "item").distinct()


def common_worth(item: np.ndarray, passage: np.ndarray) -> int:
    """What the pairs of an item that a passage holds are worth, both as word hashes: 2 for each place whose pair side
    by side stands side by side, 1 for one whose pairs are there otherwise. One word is worth 1 where it is."""

    def pairs(words: np.ndarray, apart: int) -> np.ndarray:
        return _pairs(words, np.zeros(len(words), np.int8), apart)[1]

    if len(item) == 1:
        return int(np.isin(item, passage)[0])
    near, apart = pairs(passage, 1), pairs(passage, 2)
    both = np.concatenate((near, apart))
    mine, further = pairs(item, 1), pairs(item, 2)
    there = np.isin(mine, both)
    there[: len(further)] |= np.isin(further, both)
    return int(there.sum() + np.isin(mine, near).sum())


def local_alignments(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best Smith-Waterman score, end position in ``left``) of each pair of word sequences."""
    n = len(left)
    wide = max((len(r) for r in right), default=0)
    long = max((len(x) for x in left), default=0)
    a = np.zeros((n, long), np.uint64)
    b = np.zeros((n, wide), np.uint64)
    a_size, b_size = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    for i in range(n):
        a[i, : a_size[i]] = left[i]
        b[i, : b_size[i]] = right[i]
    inside = np.arange(wide) < b_size[:, None]
    slope = -GAP * np.arange(wide + 1)
    row, best, end = np.zeros((n, wide + 1), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(long):
        gain = np.where((b == a[:, i : i + 1]) & inside, EQUAL, OTHER)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + gain, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the item
        row = np.where((i < a_size)[:, None], new, 0)
        top = row.max(axis=1)
        better = top > best
        best, end = np.where(better, top, best), np.where(better, i + 1, end)
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, to_word: documents that hold a copy of an item, and how close it is.

    ``score`` is the alignment's points over those of a full copy, 1 for a whole
    exact copy; ``to_word`` is where the best alignment of the pair ends. Only
    pairs that reach the threshold are returned. Null and empty texts match
    nothing; rows with one doc_id count together; other columns are ignored.
    """
    pairs_of_items = kept(item_pairs(items, threshold), "item-pairs")
    seeds = kept(item_seeds(pairs_of_items), "item-seeds")
    found = kept(passages(docs, seeds), "passages")
    pairs = (
        candidates(found, seeds)
        .join(pairs_of_items.select("item", "item_id", "words", "needed"), "item")
        .join(found.select("key", "doc_id", "from_word", "passage"), "key")
        .select("doc_id", "from_word", "item_id", "words", "needed", "passage")
    )

    def aligned(batches):
        for some in batches:
            words, needed, texts = (some.column(c).to_pylist() for c in ("words", "needed", "passage"))
            enough = [
                common_worth(np.frombuffer(w, np.uint64), np.frombuffer(t, np.uint64)) >= n for w, n, t in zip(words, needed, texts)
            ]
            whole = some.filter(pa.array(enough, pa.bool_()))
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left = [np.frombuffer(x, np.uint64) for x in batch.column("passage").to_pylist()]
                right = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
                # Pairs of like size share an array, so one long text does not widen all.
                points, ends = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
                order = sorted(range(len(left)), key=lambda i: (len(right[i]), len(left[i])))
                for part in [order[i : i + 32] for i in range(0, len(order), 32)]:
                    points[part], ends[part] = local_alignments([left[i] for i in part], [right[i] for i in part])
                full = np.array([EQUAL * len(r) for r in right])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("item_id"),
                        pa.array(points / full),
                        pa.array(np.asarray(batch.column("from_word")) + ends),
                    ],
                    names=["doc_id", "item_id", "score", "to_word"],
                )

    scored = pairs.mapInArrow(aligned, "doc_id bigint, item_id bigint, score double, to_word bigint")
    return (
        scored.where(F.col("score") >= threshold)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("score", "to_word")).alias("best"))
        .select("doc_id", "item_id", "best.score", "best.to_word")
    )
