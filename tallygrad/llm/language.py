"""Languages of the words of code-switched text by a linear-chain conditional random field.

Features of a word are its affixes, its character n-grams, the word itself and
whether it stands in a lexicon of frequent words of a language. Weights and
transitions are learned together from sequences whose languages switch, put
together from stretches of documents of known language. Words of a document
are labelled by forward-backward over the whole text; its language is the one
with the largest sum of word probabilities.

A word's emission does not depend on its neighbours, so it is worked out once
per distinct word of a batch; the recursions run over all texts of a batch at
once, one word position at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.draws import drawn, drawn_order, not_empty
from tallygrad.llm.quality import _marked, is_held_out
from tallygrad.llm.text import Words, mixed, pieces, span_hashes

BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4)
NGRAMS = (2, 3)
#: Documents per language that may be learned from, words taken of each, and lexicon words per language.
SAMPLE_ROWS, SAMPLE_WORDS, LEXICON_WORDS = 250, 160, 300
#: Values of lang that are learned, the most frequent ones.
MOST_LANGUAGES = 250
#: Words of a training sequence, of its stretches of one language, and number of sequences.
SEQUENCE, STRETCH, SEQUENCES = 40, (4, 20), 2400
EPOCHS, BATCH, RATE = 4, 60, 0.3
UNDETERMINED = "und"

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: np.ndarray  # sorted word hashes
    lexicon_language: np.ndarray  # language of each
    lexicon_weights: np.ndarray  # language of the lexicon x languages
    transitions: np.ndarray  # from x to


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of all features of distinct lower-case words, and the word hashes."""
    data, offsets = _marked(words)
    starts, ends = offsets[:-1], offsets[1:]
    sizes = ends - starts
    every = np.arange(len(words))
    whole = span_hashes(data, starts, ends)
    owners, hashes = [every], [whole]
    for k in AFFIXES:
        has = np.flatnonzero(sizes >= k + 2)
        owners += [has, has]
        hashes += [
            span_hashes(data, starts[has], starts[has] + k + 1),
            span_hashes(data, ends[has] - k - 1, ends[has]),
        ]
    for k in NGRAMS:
        count = np.maximum(0, sizes - 2 - k + 1)
        owner = np.repeat(every, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner] + 1
        owners.append(owner)
        hashes.append(span_hashes(data, at, at + k))
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    return np.concatenate(owners), (np.concatenate(hashes) >> shift).astype(np.int64), mixed(whole)


def _in_lexicon(model: LanguageModel, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lexicon language) of the words that stand in a lexicon."""
    if not len(model.lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.searchsorted(model.lexicon, hashes)
    size = np.searchsorted(model.lexicon, hashes, side="right") - low
    word = np.repeat(np.arange(len(hashes)), size)
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return word, model.lexicon_language[at]


def emissions(model: LanguageModel, words: pa.Array) -> np.ndarray:
    """Scores (word x language) of distinct words."""
    owner, bucket, hashes = word_features(words)
    n, k = len(words), len(model.languages)
    out = np.empty((n, k))
    for j in range(k):
        out[:, j] = np.bincount(owner, model.weights[bucket, j], n)
    word, language = _in_lexicon(model, hashes)
    np.add.at(out, word, model.lexicon_weights[language])
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Word probabilities by forward-backward; text t has the rows first[t] to first[t + 1] of ``scores``."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    longest = int(counts[0]) if len(counts) else 0
    if longest == 0:
        return np.zeros_like(scores)
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    offset = np.concatenate(([0], np.cumsum(active)))
    # Rows in the order of word positions, so that each step is one contiguous slice.
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    text = np.repeat(np.arange(len(order)), np.diff(first))
    position = np.arange(first[-1]) - first[text]
    place = offset[position] + rank[text]
    e = np.empty_like(scores)
    e[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha = np.empty_like(e)
    a = e[: active[0]]
    a = a / a.sum(axis=1, keepdims=True)
    alpha[: active[0]] = a
    for t in range(1, longest):
        low, high = offset[t], offset[t + 1]
        a = (a[: high - low] @ step) * e[low:high]
        a /= a.sum(axis=1, keepdims=True)
        alpha[low:high] = a
    beta = np.ones((active[-1], e.shape[1]))
    for t in range(longest - 2, -1, -1):
        low, high = offset[t + 1], offset[t + 2]
        b = (e[low:high] * beta) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        beta = np.ones((active[t], e.shape[1]))
        beta[: high - low] = b
        alpha[offset[t] : low] *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[place]


def _word_rows(column: pa.Array):
    """Distinct words with letters, index of each such word, and its text bounds."""
    words = Words(column, lower=True)
    letters = np.concatenate(([0], np.cumsum(_letter[words.data])))
    good = letters[words.ends] > letters[words.starts]
    distinct = words.array().dictionary_encode()
    first = np.concatenate(([0], np.cumsum(good)))[words.first]
    return distinct.dictionary, distinct.indices.to_numpy()[good], first, np.flatnonzero(good), words


def label_words(model: LanguageModel, column: pa.Array):
    """(probabilities of words with letters, first such word per text, their word numbers, words)."""
    dictionary, which, first, numbers, words = _word_rows(column)
    scores = emissions(model, dictionary)[which]
    return marginals(scores, first, model.transitions), first, numbers, words


def train(texts: list[str], languages: list[str], seed: int = 11) -> LanguageModel:
    """Fit the field to texts of one language each by stochastic gradient ascent on the conditional likelihood."""
    names = sorted(set(languages))
    k = len(names)
    model = LanguageModel(
        names, np.zeros((BUCKETS, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k)), np.zeros((k, k))
    )
    dictionary, which, first, _, _ = _word_rows(pa.array(texts, pa.string()))
    if not len(which):
        return model
    owner, bucket, hashes = word_features(dictionary)
    lexicon, of = [], []
    label_of_text = np.array([names.index(x) for x in languages])
    for j in range(k):
        mine = np.concatenate([which[first[t] : first[t + 1]] for t in np.flatnonzero(label_of_text == j)])
        ids, counts = np.unique(mine, return_counts=True)
        top = hashes[ids[np.lexsort((hashes[ids], -counts))][:LEXICON_WORDS]]
        lexicon.append(top)
        of.append(np.full(len(top), j))
    model.lexicon, model.lexicon_language = np.concatenate(lexicon), np.concatenate(of)
    order = np.argsort(model.lexicon, kind="stable")
    model.lexicon, model.lexicon_language = model.lexicon[order], model.lexicon_language[order]
    in_word, in_language = _in_lexicon(model, hashes)

    # Code-switched sequences: stretches of texts of changing language one after another.
    random = np.random.default_rng(seed)
    long_enough = np.flatnonzero(np.diff(first) > 0)
    by_language = [long_enough[label_of_text[long_enough] == j] for j in range(k)]
    usable = [j for j in range(k) if len(by_language[j])]
    sequence = np.empty((SEQUENCES, SEQUENCE), np.int64)
    target = np.empty((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQUENCE:
            j = usable[random.integers(len(usable))]
            t = by_language[j][random.integers(len(by_language[j]))]
            size = min(SEQUENCE - at, first[t + 1] - first[t], random.integers(*STRETCH))
            start = first[t] + random.integers(first[t + 1] - first[t] - size + 1)
            sequence[s, at : at + size] = which[start : start + size]
            target[s, at : at + size] = j
            at += size
    by_owner = np.argsort(owner, kind="stable")
    owner, bucket = owner[by_owner], bucket[by_owner]
    count = np.bincount(owner, minlength=len(dictionary))
    start = np.cumsum(count) - count
    seen = np.full((BUCKETS, k), 1e-8)
    bounds = np.arange(0, BATCH * SEQUENCE + 1, SEQUENCE)
    transitions_seen, lexicon_seen = np.full((k, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(EPOCHS):
        rows = random.permutation(SEQUENCES)
        for at in range(0, SEQUENCES, BATCH):
            words, gold = sequence[rows[at : at + BATCH]].ravel(), target[rows[at : at + BATCH]].ravel()
            distinct, local = np.unique(words, return_inverse=True)
            size = count[distinct]
            index = np.repeat(start[distinct] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            feature_word, feature = np.repeat(np.arange(len(distinct)), size), bucket[index]
            score = np.empty((len(distinct), k))
            for j in range(k):
                score[:, j] = np.bincount(feature_word, model.weights[feature, j], len(distinct))
            has = np.searchsorted(distinct, in_word)
            has = np.minimum(has, len(distinct) - 1)
            here = distinct[has] == in_word
            lex_word, lex_language = has[here], in_language[here]
            np.add.at(score, lex_word, model.lexicon_weights[lex_language])
            emission = score[local]
            p = marginals(emission, bounds, model.transitions)
            error = np.eye(k)[gold] - p
            word_error = np.zeros((len(distinct), k))
            np.add.at(word_error, local, error)
            used, inverse = np.unique(feature, return_inverse=True)
            gradient = np.zeros((len(used), k))
            np.add.at(gradient, inverse, word_error[feature_word])
            seen[used] += gradient**2
            model.weights[used] += RATE * gradient / np.sqrt(seen[used])
            gradient = np.zeros((k, k))
            np.add.at(gradient, lex_language, word_error[lex_word])
            lexicon_seen += gradient**2
            model.lexicon_weights += RATE * gradient / np.sqrt(lexicon_seen)
            gradient = _transition_gradient(emission, p, gold, model.transitions, k)
            transitions_seen += gradient**2
            model.transitions += RATE * gradient / np.sqrt(transitions_seen)
    return model


def _transition_gradient(emission, p, gold, transitions, k) -> np.ndarray:
    """Observed less expected transitions of sequences of equal length."""
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).reshape(BATCH, SEQUENCE, k)
    step = np.exp(transitions - transitions.max())
    forward = np.empty_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, SEQUENCE):
        a = (forward[:, t - 1] @ step) * e[:, t]
        forward[:, t] = a / a.sum(axis=1, keepdims=True)
    # Joint of t and t + 1: the marginal at t + 1 shared out by what led there.
    joint = forward[:, :-1, :, None] * step
    joint /= joint.sum(axis=2, keepdims=True)
    expected = (joint * p.reshape(BATCH, SEQUENCE, k)[:, 1:, None, :]).sum(axis=(0, 1))
    observed = np.zeros((k, k))
    g = gold.reshape(BATCH, SEQUENCE)
    np.add.at(observed, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
    return observed - expected


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learn from about ``rows`` documents per language that are not held out.

    Only text and non-null lang are used, and of the values of lang the ``languages``
    most frequent ones, so that a column of dirt stays a bounded model. The sample is drawn by a hash of the
    id at a rate from the count per language; of each document ``SAMPLE_WORDS``
    words from a place the hash names are taken.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out() & F.col("text").isNotNull()
    )
    top = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    counts = {r.lang: r["count"] for r in top.collect()}
    if not counts:
        return train([], [])
    there = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    taken = F.slice("words", F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.size("words") - SAMPLE_WORDS)).cast("int"), SAMPLE_WORDS)
    sample = (
        usable.where(F.col("lang").isin(list(counts)) & drawn(there, rows, "doc_id"))
        .withColumn("words", words)
        .select("doc_id", "lang", F.concat_ws(" ", taken).alias("text"))
        .orderBy(drawn_order("doc_id"), "doc_id", "text")
        .limit(2 * rows * len(counts))
    )
    got = sorted((r.doc_id, r.lang, r.text) for r in not_empty(sample.collect(), sum(counts.values()), "documents"))
    return train([t for _, _, t in got], [x for _, x, _ in got])


def with_language(docs: DataFrame, model: LanguageModel, runs: bool = False) -> DataFrame:
    """Documents with lang_pred and score (share of word probability), and with ``runs`` their switches.

    ``runs`` lists stretches of words with one likeliest language: word numbers
    from and to (exclusive) and the language; words without letters belong to no
    stretch of their own. Null texts and texts without letters get ``und``,
    score 0 and no runs. Columns of these names are replaced.
    """
    made = ["lang_pred", "score"] + ["runs"] * runs
    kept = [c for c in docs.columns if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets and languages

    def labelled(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for whole in batches:
            for batch in pieces(whole, size=4 << 20):
                n = batch.num_rows
                best, share = np.full(n, len(m.languages)), np.zeros(n)
                p, first, numbers, words = np.zeros((0, 0)), np.zeros(n + 1, np.int64), None, None
                if m.languages:
                    p, first, numbers, words = label_words(m, batch.column("text"))
                    total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
                    total = total[first[1:]] - total[first[:-1]]
                    has = np.diff(first) > 0
                    if has.any():
                        plain = np.concatenate(([0], np.cumsum(_plain[words.data])))[words.offsets]
                        for t in np.flatnonzero(has & (plain[1:] == plain[:-1])).tolist():  # no ASCII letter
                            text = batch.column("text")[t].as_py()
                            has[t] = any(c.isalpha() for c in text)
                    best = np.where(has, total.argmax(axis=1), best)
                    share = np.where(has, total.max(axis=1) / np.maximum(np.diff(first), 1), 0.0)
                columns = [*(batch.column(c) for c in kept), pa.array(names[best], pa.string()), pa.array(np.clip(share, 0, 1))]
                if runs:
                    columns.append(_runs(p, first, numbers, words, best, names))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in made)
    extra = ", runs array<struct<from_word:int,to_word:int,lang:string>>" if runs else ""
    return docs.select(*kept).mapInArrow(labelled, f"{schema}, lang_pred string, score double{extra}")


_plain = np.zeros(256, bool)
_plain[[*range(65, 91), *range(97, 123)]] = True


def _runs(p, first, numbers, words, best, names) -> pa.Array:
    out = []
    for t in range(len(first) - 1):
        rows = slice(first[t], first[t + 1])
        if names[best[t]] == UNDETERMINED:
            out.append([])
            continue
        label = p[rows].argmax(axis=1)
        number = numbers[rows] - words.first[t]
        change = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        ends = np.concatenate((number[change[1:]], [words.counts[t]]))
        out.append(
            [
                {"from_word": int(a), "to_word": int(b), "lang": names[label[c]]}
                for c, a, b in zip(change, number[change], ends)
            ]
        )
    return pa.array(out, pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("lang", pa.string())])))
