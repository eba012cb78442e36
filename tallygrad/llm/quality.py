"""Quality scores from supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a word (with
bounds marked) hashes to a learned vector; a document is the average of its
vectors, and a softmax layer turns that into class probabilities. Training is
stochastic gradient descent in numpy on a bounded sample of labelled documents.
As the output is linear in the vectors before the softmax, scoring folds each
vector and the output layer into one number per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrad.llm.draws import drawn, drawn_order, not_empty
from tallygrad.llm.text import Words, gram_hashes, mixed, pieces, span_hashes

BUCKETS = 1 << 17
WIDTH = 6
NGRAMS = (3, 4, 5)
#: Labelled documents that may be learned from, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 12_000
EPOCHS, BATCH, RATE = 6, 25, 0.4
#: Texts whose features are made at once in training.
FEATURE_ROWS = 10

_PAIR = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Stands for every pair of equal words, so that repetition is one feature whatever is repeated.
_SAME = np.uint64(1)


def is_held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class QualityModel:
    """Bucket vectors, output layer (2 x width) and its bias; class 1 is good."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Log odds of class 1 per bucket, and of an empty text."""
        towards = self.output[1] - self.output[0]
        return (self.vectors @ towards).astype(np.float64), float(self.bias[1] - self.bias[0])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def _marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of words between marks for their bounds."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    marked = np.full(len(data) + 2 * len(words), ord("<"), np.uint8)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(len(words)) + 1, np.diff(offsets))
    marked[place] = data
    ends = offsets[1:] + 2 * np.arange(1, len(words) + 1)
    marked[ends - 1] = ord(">")
    return marked, np.concatenate(([0], ends))


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the word itself and of its character n-grams, for an array of distinct words."""
    data, offsets = _marked(words)
    n = len(words)
    owners, buckets = [np.arange(n)], [_bucket(span_hashes(data, offsets[:-1], offsets[1:]))]
    sizes = np.diff(offsets)
    for k in NGRAMS:
        count = np.maximum(0, sizes - k + 1)
        owner = np.repeat(np.arange(n), count)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offsets[owner]
        owners.append(owner)
        buckets.append(_bucket(span_hashes(data, start, start + k)))
    return np.concatenate(owners), np.concatenate(buckets)


def _parts(column: pa.Array):
    words = Words(column)
    hashes = words.hashes()
    distinct = words.array().dictionary_encode()
    owner = words.owner()
    together = np.flatnonzero(owner[1:] == owner[:-1])
    pair_hashes = gram_hashes(hashes, 2)[together] if len(together) else np.zeros(0, np.uint64)
    pair_hashes[hashes[together] == hashes[together + 1]] = _SAME
    pairs = _bucket(mixed(pair_hashes ^ _PAIR))
    return len(column), owner, distinct, owner[together], pairs


def document_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of every text, repeats included."""
    _, owner, distinct, pair_owner, pairs = _parts(column)
    which = distinct.indices.to_numpy()
    of_word, bucket = word_features(distinct.dictionary)
    order = np.argsort(of_word, kind="stable")
    bucket = bucket[order]
    count = np.bincount(of_word, minlength=len(distinct.dictionary))
    start = np.cumsum(count) - count
    sizes = count[which]
    index = np.repeat(start[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.concatenate((np.repeat(owner, sizes), pair_owner)), np.concatenate((bucket[index], pairs))


def scores(column: pa.Array, folded: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for every text of an Arrow column."""
    n, owner, distinct, pair_owner, pairs = _parts(column)
    which = distinct.indices.to_numpy()
    of_word, bucket = word_features(distinct.dictionary)
    size = len(distinct.dictionary)
    word_sum = np.bincount(of_word, folded[bucket], size)
    word_count = np.bincount(of_word, minlength=size)
    total = np.bincount(owner, word_sum[which], n) + np.bincount(pair_owner, folded[pairs], n)
    count = np.bincount(owner, word_count[which], n) + np.bincount(pair_owner, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> QualityModel:
    """Fit vectors and output layer to texts labelled 0 or 1.

    Without rows the score of any text is 0.5. Rows are taken in an order drawn
    from the seed, with Adagrad step sizes.
    """
    random = np.random.default_rng(seed)
    vectors = (random.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    n = len(texts)
    if n == 0:
        return QualityModel(vectors, output, bias)
    buckets, weights, sizes = [], [], []
    for at in range(0, n, FEATURE_ROWS):  # so that repeats are counted before the next texts come
        owner, bucket = document_features(pa.array(texts[at : at + FEATURE_ROWS], pa.string()))
        key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner = key // BUCKETS
        buckets.append((key % BUCKETS).astype(np.int32))
        weights.append((count / np.bincount(owner, count)[owner]).astype(np.float32))
        sizes.append(np.bincount(owner, minlength=min(FEATURE_ROWS, n - at)))
    bucket, weight, first = np.concatenate(buckets), np.concatenate(weights), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    del buckets, weights
    target = np.eye(2, dtype=np.float32)[np.array(labels)]
    seen = np.zeros(BUCKETS, np.float32)
    output_seen = np.zeros_like(output)
    bias_seen = np.zeros_like(bias)
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            sizes = first[rows + 1] - first[rows]
            index = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            local, b, w = np.repeat(np.arange(len(rows)), sizes), bucket[index], weight[index]
            used, inverse = np.unique(b, return_inverse=True)
            sub = vectors[used]
            mix = np.zeros((len(rows), len(used)), np.float32)
            mix[local, inverse] = w
            hidden = mix @ sub
            logits = hidden @ output.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[rows]) / len(rows)
            step = mix.T @ (error @ output)
            seen[used] += (step**2).mean(axis=1)
            gradient, bias_gradient = error.T @ hidden, error.sum(axis=0)
            output_seen += gradient**2
            bias_seen += bias_gradient**2
            vectors[used] = sub - RATE * step / np.sqrt(seen[used] + 1e-10)[:, None]
            output -= RATE * gradient / np.sqrt(output_seen + 1e-8)
            bias -= RATE * bias_gradient / np.sqrt(bias_seen + 1e-8)
    return QualityModel(vectors, output, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out.

    Drawn by a hash of the id at a rate from the count of labels, so that tasks
    hand over about as many ids as are wanted; only ids and labels take part
    until then. Null labels, and ids with contradicting labels, are left out;
    texts longer than ``SAMPLE_CHARS`` too.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where(F.col("label") == F.col("other"))
        .select("doc_id", "label")
    )
    there = usable.count()
    ids = usable.where(drawn(there, rows, "doc_id")).orderBy(drawn_order("doc_id"), "doc_id").limit(rows)
    not_empty([] if there and ids.isEmpty() else [ids], there, "labels")
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    return texts.join(F.broadcast(ids), "doc_id")  # at most `rows` ids


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on a bounded sample; a doc_id with several rows counts once (its smallest text)."""
    sample = labelled_sample(docs, labels, label, rows).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    got = sorted((r.doc_id, r.text, r.label) for r in sample.collect())
    return train([t for _, t, _ in got], [y for _, _, y in got])


def with_score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Documents with their probability of class 1; a column of that name is replaced.

    Null and empty texts get the score of a text without features.
    """
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())  # one number per bucket

    def scored(batches):
        folded, bias = shared.value
        for whole in batches:
            for batch in pieces(whole):
                values = pa.array(scores(batch.column("text"), folded, bias), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], names=[*kept, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != name)
    return docs.select(*kept).mapInArrow(scored, f"{schema}, `{name}` double")
