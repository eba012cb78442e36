"""Licences, leaks, personal data and the learned models against plain versions and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrad.llm import decontamination, language, licences, personal, quality
from tests.llm.helpers import awkward_texts, by_id, documents, prose


# ---- licences


def _normal(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def _bigrams(words):
    return set(zip(words[:-1], words[1:]))


def licences_by_hand(text, templates, threshold=0.8):
    """Every range of words that begins and ends with runs of a template, compared by sets."""
    flat = [(i, w) for i, line in enumerate((text or "").split("\n")) for w in _normal(line)]
    words = [w for _, w in flat]
    found = []
    for name, template in templates.items():
        mine = _bigrams(_normal(template))
        if not mine:
            continue
        longest = int(len(_normal(template)) * (2 - threshold) / threshold + 1e-9) + 1
        hit = [pair in mine for pair in zip(words[:-1], words[1:])]
        for a in (i for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])):
            for b in range(a, min(len(hit), a + longest - 1)):
                run_ends = b + 1 == len(hit) or not hit[b + 1] or b == a + longest - 2
                if hit[b] and run_ends:
                    got = _bigrams(words[a : b + 2])
                    dice = 2 * len(got & mine) / (len(got) + len(mine))
                    if dice >= threshold:
                        found.append((-(2 * len(got & mine) - len(got)), -dice, b - a, a, name, b))
    taken, out = set(), []
    for _, dice, _, a, name, b in sorted(found):
        if not taken & set(range(a, b + 2)):
            taken |= set(range(a, b + 2))
            out.append((flat[a][0], flat[b + 1][0], a, b + 2, name, -dice))
    return out


def test_licences(spark):
    rng = random.Random(1)
    mit, short = licences.TEMPLATES["MIT"], licences.TEMPLATES["Apache-2.0-short"]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    texts = awkward_texts() + [
        short,
        prose(rng, 30) + "\n" + short.upper() + "\n" + prose(rng, 5),
        "Copyright 2020 X\n\n" + wrapped + "\nend of it",
        wrapped[: len(wrapped) // 2],
        "Licensed under the Apache License",
        short + "\nReleased under the MIT License.",
        "the license",
        " ".join(words[:-30] + ["other"] * 3),
        "Licensed\nunder",
    ]
    docs = documents(spark, texts)
    got = {}
    for r in licences.find_licences(docs.union(docs.where("doc_id = 12"))).collect():
        got.setdefault(r.doc_id, []).append((r.from_line, r.to_line, r.from_word, r.to_word, r.licence, round(r.dice, 9)))
    for d, text in enumerate(texts):
        want = [(*x[:5], round(x[5], 9)) for x in licences_by_hand(text, licences.TEMPLATES)]
        assert sorted(got.get(d, [])) == sorted(want * (2 if d == 12 else 1)), text
    assert got[14][0][4] == "MIT" and len(got[17]) == 2
    assert licences.find_licences(docs.where("false")).count() == 0
    assert licences.find_licences(docs, {}).count() == 0


def test_licences_with_changed_lines_and_several_in_one_document(spark):
    def wrapped(text, n=11):
        words = text.split()
        return [" ".join(words[i : i + n]) for i in range(0, len(words), n)]

    mit, gpl, apache = (wrapped(licences.TEMPLATES[n]) for n in ("MIT", "GPL-3.0-notice", "Apache-2.0-notice"))
    changed = mit[:7] + [" ".join(f"q{i}" for i in range(11))] + mit[8:]
    cc = ["Licensed under CC BY 4.0."]
    several = [mit + gpl, apache + ["", ""] + gpl, mit + apache, mit + cc, cc + cc, gpl + ["some other words here"] + mit + cc]
    texts = ["\n".join(x) for x in (changed, mit[:7] + ["an inserted line of words"] + mit[7:], *several)]
    got = {}
    for r in sorted(licences.find_licences(documents(spark, texts)).collect()):
        got.setdefault(r.doc_id, []).append((r.from_line, r.to_line, r.licence))
    m, n, a = len(mit), len(gpl), len(apache)
    assert got == {
        0: [(0, m - 1, "MIT")],
        1: [(0, m, "MIT")],
        2: [(0, m - 1, "MIT"), (m, m + n - 1, "GPL-3.0-notice")],
        3: [(0, a - 1, "Apache-2.0-notice"), (a + 2, a + n + 1, "GPL-3.0-notice")],
        4: [(0, m - 1, "MIT"), (m, m + a - 1, "Apache-2.0-notice")],
        5: [(0, m - 1, "MIT"), (m, m, "CC-BY-4.0-short")],
        6: [(0, 0, "CC-BY-4.0-short"), (1, 1, "CC-BY-4.0-short")],
        7: [(0, n - 1, "GPL-3.0-notice"), (n + 1, n + m, "MIT"), (n + m + 1, n + m + 1, "CC-BY-4.0-short")],
    }


def test_licences_inside_longer_lines(spark):
    rng = random.Random(3)
    mit, notice = licences.TEMPLATES["MIT"], licences.TEMPLATES["CC-BY-4.0"]
    texts = [
        prose(rng, 20) + " " + notice + " " + prose(rng, 20),
        prose(rng, 200) + " " + mit + " " + prose(rng, 200),
        "Released under the MIT License. See file for the rest",
        prose(rng, 9) + ". " + notice + " " + mit + " " + prose(rng, 5) + " " + notice,
    ]
    got = {}
    for r in sorted(licences.find_licences(documents(spark, texts)).collect()):
        got.setdefault(r.doc_id, []).append((r.from_word, r.to_word, r.licence, r.from_line, r.to_line))
    n, m = len(_normal(notice)), len(_normal(mit))
    assert got[0] == [(20, 20 + n, "CC-BY-4.0", 0, 0)]
    assert got[1] == [(200, 200 + m, "MIT", 0, 0)]
    assert [x[2] for x in got[2]] == ["MIT-short"]
    assert [x[2] for x in sorted(got[3])] == ["CC-BY-4.0", "MIT", "CC-BY-4.0"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abcdefgh", "\n"]), max_size=60), st.lists(st.text("abcdef", min_size=2, max_size=12), min_size=1, max_size=3),
       st.sampled_from([0.5, 0.8]))
def test_licences_are_the_best_ranges_of_words(tokens, texts, threshold):
    templates = {f"t{i}": " ".join(t) for i, t in enumerate(texts)}
    text = " ".join(tokens)
    batch = pa.RecordBatch.from_arrays([pa.array([None, text, ""], pa.string())], names=["text"])
    got = [(a, b, c, d, name, round(dice, 9)) for row, a, b, c, d, dice, name in licences._regions(batch, licences.Index(templates, threshold)) if row == 1]
    want = [(*x[:5], round(x[5], 9)) for x in licences_by_hand(text, templates, threshold)]
    assert got == want


def test_templates_from_files(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(3000))
    (tmp_path / "Long-1.0.txt").write_text(long)
    (tmp_path / "Other").write_text("a few\nwords of another licence\n")
    templates = licences.read_templates(spark, str(tmp_path))
    assert set(templates) == {"Long-1.0", "Other"}
    edited = [f"changed{i}" if i % 100 == 7 else w for i, w in enumerate(long.split())]
    texts = ["x " * 500 + " ".join(edited) + " y" * 500, " ".join(edited[:1500]), "A few words of another licence"]
    got = sorted((r.doc_id, r.licence, r.from_word, r.to_word) for r in licences.find_licences(documents(spark, texts), templates).collect())
    assert got == [(0, "Long-1.0", 500, 3500), (2, "Other", 0, 6)]


# ---- leaks


def alignment_by_hand(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            s = decontamination.EQUAL if x == y else decontamination.OTHER
            new.append(max(0, row[j] + s, row[j + 1] + decontamination.GAP, new[j] + decontamination.GAP))
        row = new
        best = max(best, *row)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=9)), min_size=1, max_size=5))
def test_alignment(pairs):
    left = [np.array(a, np.uint64) for a, _ in pairs]
    right = [np.array(b, np.uint64) for _, b in pairs]
    scores, ends = decontamination.local_alignments(left, right)
    assert scores.tolist() == [alignment_by_hand(a, b) for a, b in pairs]
    assert all(e <= len(a) for e, (a, _) in zip(ends, pairs))


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(15, 40)) for _ in range(12)] + ["tiny one here", None, "", "the same"]
    texts, want = awkward_texts(), {}
    for n in range(60):
        text = prose(rng, rng.randint(10, 200))
        if n % 3 == 0:
            item = rng.randrange(12)
            w = items[item].split()
            if n % 2:  # edited: other words, left out words, capitals and marks
                for _ in range(len(w) // 6):
                    w[rng.randrange(len(w))] = prose(rng, 1)
                del w[rng.randrange(len(w))]
                w = [x.upper() + "," if rng.random() < 0.3 else x for x in w]
            want[len(texts)] = item
            text = f"{text} {' '.join(w)} {prose(rng, 20)}"
        texts.append(text)
    docs = documents(spark, texts)
    docs = docs.union(docs.where(f"doc_id = {min(want)}"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").selectExpr("*", "'x' as gram", "1 as words")
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    split = lambda t: _normal(t or "")
    for r in got:
        full = alignment_by_hand(split(texts[r.doc_id]), split(items[r.item_id]))
        assert r.score == pytest.approx(full / (decontamination.EQUAL * len(split(items[r.item_id]))))
    # Brute force: every document against every item in full.
    for d, text in enumerate(texts):
        if d in want or len(text or "") > 20_000:
            continue
        for item in items[:12]:
            assert alignment_by_hand(split(text), split(item)) < decontamination.THRESHOLD * decontamination.EQUAL * len(split(item))
    assert decontamination.contaminated(docs.where("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_a_leak_in_most_documents_is_found_in_all(spark):
    rng = random.Random(7)
    item = prose(rng, 30)
    texts = [prose(rng, 20) + " " + item for _ in range(80)] + [prose(rng, 40) for _ in range(20)]
    texts.append(" ".join(item.split()[:18]))
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    got = {r.doc_id for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert got == {*range(80), 100}


def test_an_edited_leak_that_is_repeated_is_found_in_all(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(48)]
    texts = [" ".join(words)]
    for _ in range(60):  # every 4th word is another one: the n-grams that are left are the frequent ones
        texts.append(" ".join(f"x{rng.random()}".replace(".", "") if i % 4 == 3 else w for i, w in enumerate(words)))
    bench = spark.createDataFrame([(0, texts[0])], "item_id bigint, text string")
    got = {r.doc_id: r.score for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert set(got) == set(range(61))
    assert got[1] == pytest.approx((2 * 36 - 11) / 96)


def test_copies_edited_down_to_the_threshold_are_found(spark):
    rng = random.Random(9)
    new = lambda: f"x{rng.randrange(10**9)}"
    items = [[f"i{n}w{i if n % 3 else i % 7}" for i in range(rng.randint(4, 59))] for n in range(12)]
    texts = [" ".join(new() if i % 3 == 2 else w for i, w in enumerate(items[1]))]  # no three words in a row are left
    texts.append(" ".join(x for w in items[2] for x in (w, new())))  # nor two
    texts.append(" ".join(w for i, w in enumerate(items[4]) if i % 3))
    while len(texts) < 150:
        words, share = [], rng.random() * 0.6
        for w in rng.choice(items):
            edit = rng.choice(("other", "more", "none")) if rng.random() < share else ""
            words += [w] * (edit in ("", "more")) + [new()] * (edit in ("other", "more"))
        texts.append(" ".join([new() for _ in range(rng.randrange(80))] + words + [new() for _ in range(rng.randrange(80))]))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    scores = {(d, n): alignment_by_hand(t.split(), w) / (decontamination.EQUAL * len(w)) for d, t in enumerate(texts) for n, w in enumerate(items)}
    assert got == pytest.approx({k: v for k, v in scores.items() if v >= decontamination.THRESHOLD})
    assert {(0, 1), (1, 2), (2, 4)} <= set(got) and 50 < len(got) < 150


def test_tiny_items_are_found_where_they_stand_whole(spark):
    rng = random.Random(10)
    items = ["Qa", "qb qc", "qd qe qf", "qg qh qi qj", "qk qk", " - "]
    whole = [f"{prose(rng, 8)} {item}, {prose(rng, 8)}" for item in items[:5]]
    # The n-grams of the four words differ in how many documents hold them.
    texts = whole + ["qg qh qi", "qb", "qc qb", "qb x qc", "qk x qk", "qd", prose(rng, 50), None] + ["qh qi qj"] * 9
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert {k: v for k, v in got.items() if k[0] < 5} == {(n, n): 1 for n in range(5)}
    assert set(got) == {(n, n) for n in range(5)} | {(5, 3)} | {(n, 3) for n in range(13, 22)}


# ---- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def spans_by_hand(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    check = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and check(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab1234.@-+%() é_", max_size=40) | st.from_regex(r"[ab+ ]{0,4}(4[0-9 -]{12,20}|\+[0-9() -]{7,18}|[0-9.]{5,16})[ .x@a]{0,5}", fullmatch=True))
def test_base_spans(text):
    assert personal.base_spans(text) == spans_by_hand(text)


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000):
        personal.base_spans(text)
    assert personal.base_spans("9" * 5000 + ".1.1.1") == []


def test_training_learns_from_texts_late_in_the_alphabet():
    # Numbers of the first texts fill the bound by themselves; only the last ones hold entities.
    early = [f"a{n:03d} " + " ".join(f"one two three four five six {i}" for i in range(40)) for n in range(100)]
    late = [f"\u4e2d write to some{n}@mail.example.org now" for n in range(100)]
    learned = personal.train(early + late).weights
    assert not (learned == personal.train(early).weights).all()


def private_text(rng):
    """A text with the kinds of personal data in it."""
    body = prose(rng, rng.randint(5, 30))
    for _ in range(rng.randint(0, 3)):
        number = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        number += next(c for c in "0123456789" if personal.luhn(number + c))
        body += " " + rng.choice(
            (
                f"{prose(rng, 1)}.{rng.randint(1, 99)}@mail.example.com",
                ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                number,
                f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                f"in {rng.randint(1900, 2030)} about {rng.randint(1, 999)} times, version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
            )
        ) + rng.choice((" ", ". ", ", ")) + prose(rng, rng.randint(0, 4))
    return body


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    return personal.train([private_text(rng) for _ in range(300)])


def test_personal_data(spark, field):
    rng = random.Random(4)
    texts = awkward_texts() + [private_text(rng) for _ in range(60)]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 20"))
    rows = personal.find(docs, field).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = spans_by_hand(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in personal.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        assert spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        taken = {i for _, a, b in want for i in range(a, b)}
        assert not taken & {i for s in spans if s not in want for i in range(s[1], s[2])}
    hidden = by_id(personal.mask(docs.where("doc_id != 20"), field))
    for d, text in enumerate(texts):
        if d != 20:
            assert (hidden[d].text is None) == (text is None)
            assert not spans_by_hand(hidden[d].text) or "@" in hidden[d].text
            if text is not None and not any(c in "@0123456789" for c in text):
                assert hidden[d].text == text
            assert hidden[d].n_chars == (None if text is None else len(hidden[d].text))


def test_the_field_adds_what_patterns_miss(field):
    found = 0
    for text, kind in (
        ("ring me at (724) 555-7058 or so", "phone"),
        ("pay with 4242.4242.4242.4242 now", "card"),
        ("tel +1 (269) 555-3296 4524132264652876 end", "phone"),
    ):
        base, every = personal.all_spans(text, field)
        found += any(k == kind for k, _, _ in every if (k, _, _) not in base)
    assert found >= 2
    for text in ("in 2024 there were 12 of 340", "version 2.0.", "chapter 3.1.4 page 77", "prose without any of it"):
        assert personal.all_spans(text, field) == ([], [])


def test_segment_sums_against_all_segmentations(field):
    text = "a 12 b@c.de 4 1.2.3.4"
    (window,) = personal._windows(text, [])
    n = len(window.words)
    ahead, back, score = personal._sums(window, field.weights)

    def every(i):
        if i == n:
            yield 0.0, ()
            return
        for rest, segments in every(i + 1):
            yield rest, segments
        for size in range(1, personal.LONGEST + 1):
            if (i, size) in score:
                for kind, s in enumerate(score[i, size]):
                    for rest, segments in every(i + size):
                        yield s + rest, ((i, size, kind), *segments)

    alls = list(every(0))
    total = np.logaddexp.reduce([s for s, _ in alls])
    assert ahead[n] == pytest.approx(total) and back[0] == pytest.approx(total)
    got = personal._best(window, field.weights)
    assert dict((x, s) for s, x in alls)[tuple(x[:3] for x in got)] == pytest.approx(max(alls)[0])
    for start, size, kind, p in got:
        share = np.logaddexp.reduce([s for s, x in alls if (start, size, kind) in x]) - total
        assert p == pytest.approx(np.exp(share))


def test_field_without_examples(spark):
    docs = documents(spark, ["plain words", None])
    model = personal.fit(docs)
    assert personal.find(docs, model).where("spans != ''").count() == 0
    assert personal.find(docs.where("false"), model).count() == 0


# ---- learned models


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    scores, transitions = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 7])
    got = language.marginals(scores, first, transitions)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            v = np.exp(sum(scores[a + i, y[i]] for i in range(b - a)) + sum(transitions[y[i], y[i + 1]] for i in range(b - a - 1)))
            for i in range(b - a):
                want[i, y[i]] += v
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


ENDINGS = {"xx": "ka ko ku".split(), "yy": "lis les las".split(), "zz": "orn arn urn".split()}


def in_language(rng, lang, n):
    return " ".join(word + rng.choice(ENDINGS[lang]) for word in prose(rng, n).split())


def language_docs(spark, n=150):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ENDINGS))
        rows.append((i, in_language(rng, lang, rng.randint(5, 80)), lang if i % 10 else None, "s", 0, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, truth string")


@pytest.fixture(scope="module")
def speaker(spark):
    return language.fit(language_docs(spark))


def test_language_of_held_out_documents(spark, speaker):
    assert speaker.languages == sorted(ENDINGS)
    got = language.with_language(language_docs(spark), speaker).withColumn("held_out", quality.is_held_out()).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 150 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.truth for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert all(np.diag(speaker.transitions) > 0)  # languages stay more often than they switch


def test_code_switched_text(spark, speaker):
    rng = random.Random(5)
    text = in_language(rng, "xx", 12) + " 12 34 " + in_language(rng, "zz", 15)
    row = language.with_language(documents(spark, [text]), speaker, runs=True).first()
    assert [r.lang for r in row.runs] == ["xx", "zz"] and row.lang_pred == "zz"
    assert row.runs[0].from_word == 0 and row.runs[-1].to_word == 29 and abs(row.runs[1].from_word - 14) <= 1


def test_language_of_awkward_texts(spark, speaker):
    texts = awkward_texts() + ["123 456", "!!! ...", "€€€ ¿¿", "ñandú", "日本"]
    rows = by_id(language.with_language(documents(spark, texts), speaker))
    for d, text in enumerate(texts):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[d].lang_pred != "und") == letters and (letters or rows[d].score == 0)
    assert all(r.key == "key" for r in rows.values())
    assert language.with_language(documents(spark, ["x"]).where("false"), speaker).count() == 0


def test_language_without_labelled_rows(spark):
    docs = documents(spark, ["some words"], lang=None)
    assert language.with_language(docs, language.fit(docs)).first().lang_pred == "und"


def quality_docs(spark, n=260):
    rng = random.Random(15)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice((text.upper().replace(" ", "!! "), text.replace(" ", " | "), (prose(rng, 1) + " ") * 60))
        texts.append(text)
        if i % 8:
            labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), texts


def test_quality_of_held_out_documents(spark):
    docs, labels, texts = quality_docs(spark)
    model = quality.fit(docs, labels)
    rows = by_id(quality.with_score(docs, model).withColumn("held_out", quality.is_held_out()))
    truth = {r.doc_id: r.quality for r in labels.where("doc_id is not null and doc_id != 4 and quality is not null").collect()}
    held = [d for d in truth if rows[d].held_out]
    assert len(held) > 30
    assert sum((rows[d].score >= 0.5) == bool(truth[d]) for d in held) >= 0.9 * len(held)
    assert quality.with_score(docs, model).columns[-1] == "score" and len(rows) == len(texts)
    # Folding the output layer into the vectors changes nothing.
    owner, bucket = quality.document_features(pa.array(texts[:5]))
    for t in range(5):
        hidden = model.vectors[bucket[owner == t]].mean(axis=0)
        z = model.output @ hidden + model.bias
        assert rows[t].score == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-4)


def test_held_out_rows_are_never_learned_from(spark):
    docs, labels, _ = quality_docs(spark, 60)
    sample = quality.labelled_sample(docs, labels, "quality").collect()
    assert sample and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in sample)
    few = quality.labelled_sample(docs, labels, "quality", rows=10).count()
    assert 0 < few <= 10


def test_quality_of_awkward_texts(spark):
    docs, labels, _ = quality_docs(spark, 60)
    model = quality.fit(docs, labels)
    rows = by_id(quality.with_score(documents(spark, awkward_texts()), model))
    prior = 1 / (1 + np.exp(-model.folded()[1]))
    assert all(rows[d].score == pytest.approx(prior) for d in (0, 1, 2)) and all(0 <= r.score <= 1 for r in rows.values())
    assert quality.with_score(docs.where("false"), model).count() == 0
    unlearned = quality.fit(docs, labels.where("false"))
    assert quality.with_score(docs, unlearned).first().score == 0.5


def test_common_worth_is_that_of_the_places():
    def hashes(text):
        return np.array([ord(c) * 2654435761 + 12345 for c in text], np.uint64)

    def by_hand(item, passage):
        near = {passage[i : i + 2] for i in range(len(passage) - 1)}
        apart = {passage[i] + passage[i + 2] for i in range(len(passage) - 2)}
        if len(item) == 1:
            return int(item in passage)
        total = 0
        for i in range(len(item) - 1):
            further = item[i] + item[i + 2] if i + 2 < len(item) else None
            total += 2 if item[i : i + 2] in near else 1 if item[i : i + 2] in apart or further in near | apart else 0
        return total

    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
        passage = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        assert decontamination.common_worth(hashes(item), hashes(passage)) == by_hand(item, passage)


def test_pairs_of_words_that_all_items_share_are_no_seeds(spark):
    """A benchmark ten times larger whose items share a third of their words: passages meet the items they copy, not all."""
    frame = [f"frame{i}" for i in range(8)]
    counts = []
    for n in (20, 200):
        items = [" ".join(frame[:4] + [f"own{i}x{j}" for j in range(16)] + frame[4:]) for i in range(n)]
        texts = [" ".join([*(f"t{d}w{j}" for j in range(20)), *frame, items[d % n], f"t{d}end"]) for d in range(60)]
        bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
        made = decontamination.item_pairs(bench).persist()  # its numbers differ from run to run
        seeds = decontamination.item_seeds(made).persist()
        found = decontamination.passages(documents(spark, texts, extra=False), seeds).persist()
        rare = decontamination.rare_seeds(found, seeds)
        least = seeds.groupBy("item").agg(F.first("needed").alias("needed"))
        assert rare.select("item").distinct().count() == n and least.where("needed < 1").count() == 0
        counts.append(decontamination.candidates(found, seeds).count())
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(spark, texts, extra=False), bench).collect()}
        assert got >= {(d, d % n) for d in range(60)}
        for table in (made, seeds, found):
            table.unpersist()
    assert counts == [60, 60]


def test_the_filter_follows_the_benchmark():
    assert decontamination.filter_bits(0) == decontamination.filter_bits(100) == 16
    assert decontamination.filter_bits(60_000) == 20 and decontamination.filter_bits(10**9) == 22


def plain_mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def plain_hash(data):
    """Hash of up to 256 bytes, eight at a time."""
    state = len(data) * 0x9E3779B97F4A7C15 % 2**64
    for at in range(0, len(data), 8):
        state = plain_mixed(state ^ int.from_bytes(data[at : at + 8], "little"))
    return state


def plain_features(text):
    """Buckets of all features of a text, one word at a time."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    found = []
    for word in words:
        marked = b"<" + word + b">"
        found.append(plain_hash(marked))
        found += [plain_hash(marked[i : i + k]) for k in quality.NGRAMS for i in range(len(marked) - k + 1)]
    for a, b in itertools.pairwise(words):
        pair = 2
        for h in (plain_hash(a), plain_hash(b)):
            pair = (pair * 0xD1342543DE82EF95 + h) % 2**64
        found.append(plain_mixed((1 if a == b else plain_mixed(pair)) ^ 0xA5A5A5A5A5A5A5A5))
    return [h >> (64 - 17) for h in found]


def test_quality_scores_are_those_of_plain_python():
    rng = random.Random(15)
    texts = [t if t is None else t[:3000] for t in awkward_texts()] + [prose(rng, rng.randint(1, 40)) for _ in range(30)]
    texts = [None if t is None else " ".join(w for w in t.split(" ") if len(w) < 100) for t in texts]
    labels = [int(rng.random() < 0.5) for _ in texts]
    owner, bucket = quality.document_features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == sorted(plain_features(text))
    model = quality.train(texts, labels)
    folded, bias = model.folded()
    got = quality.scores(pa.array(texts, pa.string()), folded, bias)
    for text, score in zip(texts, got):
        found = plain_features(text)
        mean = sum(model.vectors[b].astype(float) for b in found) / max(1, len(found)) if found else np.zeros(quality.WIDTH)
        logits = model.output.astype(float) @ mean + model.bias
        odds = np.exp(logits - logits.max())
        assert score == pytest.approx(odds[1] / odds.sum(), abs=1e-5)


def test_quality_training_follows_the_gradient():
    """One step over one batch against differences of the loss."""
    rng = random.Random(16)
    texts = [prose(rng, 6) for _ in range(quality.BATCH)]
    labels = [i % 2 for i in range(len(texts))]
    before = quality.scores(pa.array(texts), *quality.train([], []).folded())
    assert np.allclose(before, 0.5)
    model = quality.train(texts * 8, labels * 8)
    after = quality.scores(pa.array(texts), *model.folded())
    loss = lambda p: -np.mean([np.log(x if y else 1 - x) for x, y in zip(p, labels)])
    assert loss(after) < 0.7 * loss(before)
    assert np.mean((after > 0.5) == np.array(labels, bool)) > 0.9
