"""Personal data in text: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans. The field scores whole candidate segments of
up to ``LONGEST`` words by features of the segment as a whole (digits, groups,
check sums, marks), and a dynamic program over the words picks boundaries and
types together. Segments without a digit or an at sign can't be entities, so
only the words around such triggers take part; words of base spans are left out,
so the field only ever adds spans. A segment counts when its probability, by
the forward and backward sums of the same program, reaches ``SURE``.

The field learns from base spans of a bounded sample of documents, and from the
same spans written in ways the patterns miss.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.draws import drawn, drawn_order, not_empty
from tallygrad.llm.text import buffers, pieces

KINDS = ("email", "ip", "card", "phone")
#: Words of the longest entity, words of context around triggers, and least probability of an added span.
LONGEST, AROUND, SURE = 5, 2, 0.8
#: Documents with triggers that may be learned from, and characters taken around each trigger.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
#: Windows that are learned from, drawn from all of those documents in an order of this seed.
SAMPLE_WINDOWS, SEED = 3_000, 7
EPOCHS, RATE = 60, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts, so no start is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of a local part, an at sign and a dotted domain, found from the at signs in linear time."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return spans


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start. Null and empty texts have none."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field

_FEATURES = 34


def _features(segment: str, n_words: int, first: str, last: str) -> list[int]:
    """Numbers of the features that hold for a whole segment, edges of punctuation taken off."""
    core = segment.strip(_EDGE)
    digits = _NOT_DIGIT.sub("", core)
    n, letters = len(digits), sum(c.isalpha() for c in core)
    groups = [g for g in re.split(r"[^0-9]+", core) if g][:9]
    on = [0, min(n_words, 4)]
    on.append(5 if n == 0 else 6 if n < 7 else 7 if n < 9 else 8 if n < 13 else 9 if n < 20 else 10)
    ats = core.count("@")
    if ats:
        on.append(11 if ats == 1 else 12)
        local, _, domain = core.partition("@")
        if local.strip() and "." in domain.strip().strip("."):
            on.append(13)
        if re.search(r"\s", core.replace(" @ ", "@").replace(" . ", ".").replace(" .", ".")):
            on.append(14)
    if letters == 0:
        on.append(15)
    elif not ats:
        on.append(16)
    if 13 <= n <= 19:
        on.append(17 if luhn(digits) else 18)
    if len(groups) == 4 and letters == 0 and not ats:
        on.append(19 if all(len(g) <= 3 and int(g) <= 255 for g in groups) else 20)
        if re.fullmatch(r"[0-9]+(?:\s?\.\s?[0-9]+){3}", core):
            on.append(21)
    if core.startswith("+") or core.startswith("00"):
        on.append(22)
    if "(" in core and ")" in core:
        on.append(23)
    if re.search(r"[0-9]-[0-9]", core):
        on.append(24)
    if letters == 0 and re.fullmatch(r"\(?\+?[0-9]{1,4}\)?[\s.-]?\(?[0-9]{2,4}\)?(?:[\s./-]?[0-9]{2,5}){1,4}", core):
        on.append(25)
    if len(groups) >= 3 and all(2 <= len(g) <= 4 for g in groups[-3:]):
        on.append(26)
    if not _triggered(first):
        on.append(27)
    if not _triggered(last):
        on.append(28)
    if re.search(r"[/:=_$%*#|]", core):
        on.append(29)
    if len(groups) == 1:
        on.append(30)
    if len(core) != len(segment.strip()):
        on.append(31)
    if n and letters and not ats:
        on.append(32)
    if re.search(r"[0-9]\.[0-9]", core):
        on.append(33)
    return on


def _triggered(word: str) -> bool:
    return "@" in word or any("0" <= c <= "9" for c in word)


@dataclass
class FieldModel:
    """Weights (feature x kind); everything else scores 0."""

    weights: np.ndarray


@dataclass
class _Window:
    """Words around triggers as (start, end), and features of the candidate segments by (start, length)."""

    words: list[tuple[int, int]]
    on: dict[tuple[int, int], list[int]]


def _windows(text: str, taken: list[tuple[int, int]]) -> list[_Window]:
    """Stretches of words near triggers, without the words that overlap ``taken`` spans."""
    taken = sorted(taken)
    words, free = [], []
    at = 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        words.append((m.start(), m.end()))
        free.append(not (at < len(taken) and taken[at][0] < m.end()))
    triggers = [i for i, (a, b) in enumerate(words) if free[i] and _triggered(text[a:b])]
    wanted = sorted({j for i in triggers for j in range(max(0, i - AROUND), min(len(words), i + AROUND + 1)) if free[j]})
    out, run = [], []
    for j in [*wanted, None]:
        if run and (j is None or j != run[-1] + 1):
            bounds = [words[i] for i in run]
            hot = [_triggered(text[a:b]) for a, b in bounds]
            on = {}
            for i in range(len(run)):
                for size in range(1, min(LONGEST, len(run) - i) + 1):
                    if any(hot[i : i + size]):
                        a, b = bounds[i][0], bounds[i + size - 1][1]
                        first, last = text[slice(*bounds[i])], text[slice(*bounds[i + size - 1])]
                        on[i, size] = _features(text[a:b], size, first, last)
            out.append(_Window(bounds, on))
            run = []
        if j is not None:
            run.append(j)
    return out


def _sums(window: _Window, weights: np.ndarray):
    """Forward and backward log sums, and the scores (kind) of each candidate segment."""
    n = len(window.words)
    score = {k: weights[on].sum(axis=0) for k, on in window.on.items()}
    total = {k: float(np.logaddexp.reduce(s)) for k, s in score.items()}
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(1, n + 1):
        terms = [ahead[i - 1]] + [ahead[i - s] + total[i - s, s] for s in range(1, min(LONGEST, i) + 1) if (i - s, s) in total]
        ahead[i] = float(np.logaddexp.reduce(terms))
    for i in range(n - 1, -1, -1):
        terms = [back[i + 1]] + [back[i + s] + total[i, s] for s in range(1, min(LONGEST, n - i) + 1) if (i, s) in total]
        back[i] = float(np.logaddexp.reduce(terms))
    return ahead, back, score


def _best(window: _Window, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start word, words, kind, probability) of the segments of the best segmentation."""
    ahead, back, score = _sums(window, weights)
    n = len(window.words)
    best, step = [0.0] * (n + 1), [None] * (n + 1)
    for i in range(1, n + 1):
        best[i] = best[i - 1]
        for s in range(1, min(LONGEST, i) + 1):
            if (i - s, s) in score:
                kind = int(score[i - s, s].argmax())
                value = best[i - s] + float(score[i - s, s][kind])
                if value > best[i]:
                    best[i], step[i] = value, (i - s, s, kind)
    out, i = [], n
    while i > 0:
        if step[i]:
            start, s, kind = step[i]
            p = np.exp(ahead[start] + score[start, s][kind] + back[start + s] - ahead[n])
            out.append((start, s, kind, float(p)))
            i = start
        else:
            i -= 1
    return out[::-1]


def _rewritten(kind: str, span: str, turn: int) -> str:
    """A base span in a form that the patterns do not know."""
    if kind == "email":
        return (span.replace("@", " @ "), span.replace("@", "@ "), span.replace("@", " @"))[turn % 3]
    if kind == "ip":
        return span.replace(".", " . ") if turn % 2 else span.replace(".", ". ")
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if turn % 2 else "  ".join(
            digits[i : i + 4] for i in range(0, len(digits), 4)
        )
    tail = digits[-10:]
    return (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{digits[:-10]} {tail[:3]} {tail[3:6]} {tail[6:]}")[
        turn % 3
    ]


def _examples(texts: list[str]) -> list[tuple[_Window, dict[tuple[int, int], int]]]:
    """Windows with their gold segments: (start word, words) -> kind."""
    out = []
    turn = 0
    for text in texts:
        spans = base_spans(text)
        clear, end = [], -1
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= end:
                clear.append((kind, a, b))
                end = b
        variants = [(text, clear)]
        if clear:
            parts, gold, at, size = [], [], 0, 0
            for kind, a, b in clear:
                turn += 1
                new = _rewritten(kind, text[a:b], turn)
                parts += [text[at:a], new]
                size += a - at
                gold.append((kind, size, size + len(new)))
                size += len(new)
                at = b
            variants.append(("".join([*parts, text[at:]]), gold))
        for body, gold in variants:
            for window in _windows(body, []):
                labels = {}
                for kind, a, b in gold:
                    inside = [i for i, (x, y) in enumerate(window.words) if x < b and y > a]
                    if inside and (inside[0], len(inside)) in window.on:
                        labels[inside[0], len(inside)] = KINDS.index(kind)
                out.append((window, labels))
    return out


def train(texts: list[str]) -> FieldModel:
    """Fit segment weights by gradient ascent on the likelihood of the gold segmentations; none without texts."""
    weights = np.zeros((_FEATURES, len(KINDS)))
    weights[0] = -2.0
    examples = _examples(sorted(texts))
    random.Random(SEED).shuffle(examples)
    examples = examples[:SAMPLE_WINDOWS]
    if not any(labels for _, labels in examples):
        return FieldModel(np.full_like(weights, -9.0))
    # All candidates of all windows as one table, so that an epoch is a few array operations.
    seen = np.full_like(weights, 1e-6)
    keys, rows, gold = [], [], []
    for w, (window, labels) in enumerate(examples):
        for (i, s), on in window.on.items():
            row = np.zeros(_FEATURES)
            row[on] = 1
            rows.append(row)
            keys.append((w, i, s))
            target = np.zeros(len(KINDS))
            if (i, s) in labels:
                target[labels[i, s]] = 1
            gold.append(target)
    rows, gold, keys = np.array(rows), np.array(gold), np.array(keys)
    n = np.array([len(window.words) for window, _ in examples])
    longest = int(n.max())
    for _ in range(EPOCHS):
        score = rows @ weights
        high = score.max(axis=1)
        total = high + np.log(np.exp(score - high[:, None]).sum(axis=1))
        table = np.full((len(n), longest + LONGEST + 1, LONGEST + 1), -np.inf)
        table[keys[:, 0], keys[:, 1], keys[:, 2]] = total
        ahead = np.full((len(n), longest + 1), -np.inf)
        ahead[:, 0] = 0
        for i in range(1, longest + 1):
            terms = [ahead[:, i - 1]] + [ahead[:, i - s] + table[:, i - s, s] for s in range(1, min(LONGEST, i) + 1)]
            ahead[:, i] = np.logaddexp.reduce(terms, axis=0)
        # Words behind a window's end are outside of it and add nothing.
        back = np.zeros((len(n), longest + LONGEST + 1))
        for i in range(longest - 1, -1, -1):
            terms = [back[:, i + 1]] + [back[:, i + s] + table[:, i, s] for s in range(1, LONGEST + 1)]
            back[:, i] = np.where(i < n, np.logaddexp.reduce(terms, axis=0), 0.0)
        w, i, s = keys.T
        all_of = ahead[w, n[w]]
        p = np.exp(ahead[w, i][:, None] + score + back[w, i + s][:, None] - all_of[:, None])
        gradient = rows.T @ (gold - p) - 0.05 * weights
        seen += gradient**2
        weights += RATE * gradient / np.sqrt(seen)
    return FieldModel(weights)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> FieldModel:
    """Learn from at most ``rows`` documents that hold a digit or an at sign, drawn by a hash of the id.

    Longer texts than ``SAMPLE_CHARS`` are left out of the sample, and of it alone.
    """
    usable = docs.select("doc_id", "text").where(
        F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull()
    )
    there = usable.count()
    sample = usable.where(drawn(there, rows, "doc_id")).orderBy(drawn_order("doc_id"), "text").limit(rows)
    return train([r.text for r in not_empty(sample.collect(), there, "documents")])


def all_spans(text: str | None, model: FieldModel) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind and then start."""
    base = base_spans(text)
    if not text:
        return base, base
    added = []
    for window in _windows(text, [(a, b) for _, a, b in base]):
        if window.on:
            for start, size, kind, p in _best(window, model.weights):
                if p >= SURE:
                    a, b = window.words[start][0], window.words[start + size - 1][1]
                    while a < b and text[a] in _EDGE:
                        a += 1
                    while b > a and text[b - 1] in _EDGE:
                        b -= 1
                    if a < b:
                        added.append((KINDS[kind], a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans) -> str:
    """Text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at, reach = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < reach:
            reach = max(reach, b)
            at = reach
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = reach = b
    return "".join([*out, text[at:]])


def _rows(column: pa.Array, model: FieldModel):
    """(row, text, base spans, all spans) of the texts that hold a digit or an at sign."""
    data, offsets = buffers(column)
    hot = np.concatenate(([0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))))
    for row in np.flatnonzero(hot[offsets[1:]] > hot[offsets[:-1]]).tolist():
        text = column[row].as_py()
        yield row, text, *all_spans(text, model)


def find(docs: DataFrame, model: FieldModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added.

    One row per row of ``docs``; null and empty texts have no spans. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        none = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in pieces(whole):
                n = batch.num_rows
                counts = np.zeros((5, n), np.int64)
                digest, spans = [none] * n, [""] * n
                for row, _, base, every in _rows(batch.column("text"), shared.value):
                    for kind, _, _ in base:
                        counts[KINDS.index(kind), row] += 1
                    counts[4, row] = len(every) - len(base)
                    digest[row], spans[row] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c) for c in counts[:4]), pa.array(digest), pa.array(spans), pa.array(counts[4])],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(found, schema)


def mask(docs: DataFrame, model: FieldModel) -> DataFrame:
    """Documents with all spans of their text replaced by their kind; n_chars follows where it is there. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def hidden(batches):
        for whole in batches:
            for batch in pieces(whole):
                column = batch.column("text")
                changed = {row: masked(text, every) for row, text, _, every in _rows(column, shared.value) if every}
                if changed:
                    new = pa.array([changed.get(i) for i in range(batch.num_rows)], column.type)
                    column = pc.coalesce(new, column)
                    batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), column)
                yield batch

    out = docs.mapInArrow(hidden, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
