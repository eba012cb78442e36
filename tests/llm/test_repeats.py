"""Substring removal, Jaccard groups, components and embeddings against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallygrad.llm import decontamination, embeddings, jaccard, substrings
from tallygrad.llm.components import connected_components
from tallygrad.llm.text import Words, gram_hashes, pieces, shingle_sets, span_hashes
from tests.llm.helpers import awkward_texts, by_id, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(" \t\nab中é\x85", max_size=20), max_size=8), st.integers(1, 4))
def test_words_and_shingles(texts, k):
    words = Words(pa.array(texts, pa.string()), lower=True)
    hashes = words.hashes()
    plain = [WORD.findall(t or "") for t in texts]
    assert words.counts.tolist() == [len(w) for w in plain]
    assert [w.decode() for w in words.array().to_pylist()] == [w for ws in plain for w in ws]
    flat = [w for ws in plain for w in ws]
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    owner, _ = shingle_sets(words, hashes, k)
    want = [len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) if w else 0 for w in plain]
    assert np.bincount(owner, minlength=len(texts)).tolist() == want
    assert len(gram_hashes(hashes, k)) == max(0, len(flat) - k + 1)


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 900, 3, 0)] + [None]), pa.array(range(6))], names=["text", "i"])
    got = [i for p in pieces(batch, size=10) for i in p.column("i").to_pylist()]
    assert got == list(range(6))


def windows_by_hand(texts, size=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    passage, other = prose(rng, 40).split(), prose(rng, 25).split()
    texts = awkward_texts()
    for i in range(25):
        w = prose(rng, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 2)):
            source = rng.choice((passage, other))
            a = rng.randint(0, len(source) - 1)
            span = source[a : a + rng.randint(5, 30)]
            if rng.random() < 0.4 and span:
                span[rng.randrange(len(span))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = span
        texts.append(rng.choice((" ", "\n", "\t ")).join(w))
    texts += ["r " * 50, "r " * 60, " ".join(passage), " ".join(passage)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    texts = repeated_texts(seed)
    docs = documents(spark, texts).repartition(4)
    docs = docs.union(docs.where("doc_id = 5").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]))
    want = windows_by_hand(texts)
    rows = substrings.digests(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.n_words == want[5][0]
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3], texts[r.doc_id]
    assert any(r.n_removed for r in rows)
    texts_out = by_id(substrings.remove_repeats(docs.where("doc_id is not null")))
    assert all(texts_out[d].text == w[3] for d, w in enumerate(want))


def test_substrings_repeated_rows_and_empty_table(spark):
    text = prose(random.Random(4), 30)
    docs = documents(spark, ["a b", text])
    same = docs.union(docs)
    rows = substrings.digests(same).collect()
    assert len(rows) == 4 and not any(r.n_removed for r in rows)
    assert substrings.digests(docs.where("false")).count() == 0


def shingles_by_hand(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar_texts(seed):
    rng = random.Random(seed)
    texts = awkward_texts() + ["Same SAME " * 40, "a b", "A  b", "b a"]
    for _ in range(6):
        base = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                base = w  # chains of copies
    common = prose(rng, 30)
    texts += [common + " " + prose(rng, rng.randint(0, 6)) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, k, percent", [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_jaccard_groups(spark, seed, k, percent):
    texts = similar_texts(seed)
    docs = documents(spark, texts).repartition(4)
    docs = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 4").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]))
    sets = [shingles_by_hand(t, k) for t in texts]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = groups_of(range(len(texts)), links)
    rows = jaccard.similar_groups(docs, k, percent).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(sets[4])
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_jaccard_empty_table(spark):
    assert jaccard.similar_groups(documents(spark, ["x"]).where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.sampled_from([60, 80, 90]))
def test_prefix_lengths(estimates, percent):
    estimates = np.sort(np.array(estimates))
    matches, length = jaccard.matches_and_prefix(estimates, percent)
    least = math.ceil(percent * len(estimates) / 100)
    assert 1 <= matches <= least and length == len(estimates) - least + matches <= len(estimates)


def test_costly_prefixes_are_lengthened():
    matches = [jaccard.matches_and_prefix(np.full(100, x), 90)[0] for x in (0, 5, 50, 5000)]
    assert matches == sorted(matches) and 1 < matches[0] < matches[2]
    # Where longer prefixes run into frequent shingles, fewer matches are asked for.
    assert jaccard.matches_and_prefix(np.array([0] * 12 + [10**6] * 88), 90)[0] < matches[2]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i + 300, i + 301) for i in range(40)] + [(7, 7)]
    want = groups_of({n for x in links for n in x}, links)
    df = spark.createDataFrame([*links, (None, 3), *links[:5]], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert connected_components(df.where("false")).count() == 0


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((i, (base + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05, 0.2])).tolist(), label))
                i += 1
    base = rng.normal(size=16)
    for _ in range(60):
        rows.append((i, (base * rng.uniform(0.1, 9) + rng.normal(size=16) * 0.01).tolist(), 1))
        i += 1
    nan, inf = float("nan"), float("inf")
    for bad in (None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16):
        rows.append((i, bad, 1))
        i += 1
    return rows


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embeddings, "LISTS", (8, 512))
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' as list", "1 as unit")
    unit = {}
    for i, v, label in rows:
        x = np.array([np.nan if c is None else np.float32(c) for c in v or []], np.float64)
        if label is not None and len(x) and np.isfinite(x).all() and np.any(x):
            x = x / np.abs(x).max()
            unit[i] = label, x / np.linalg.norm(x)
    links = [
        (a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98
    ]
    want = groups_of([r[0] for r in rows], links)
    count = {i: sum(i in x for x in links) for i, _, _ in rows}
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows) and len(links) > 100
    for i in count:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], want[i], want[i] == i)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embedding_bounds_hold():
    """Probes and table distances never leave out a partner."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x = np.concatenate((x, x + rng.normal(size=x.shape) * 0.04))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embeddings.train(x)
    limit = math.sqrt(2 - 2 * 0.98)
    lists, probes = q.lists(x), q.probes(x, limit)
    codes, error = q.encode(x, lists)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert probes[a, lists[b]].all()
    for c in range(len(q.centroids)):
        rows = np.flatnonzero(lists == c)
        d = q.table_distances(x, c, codes[rows])
        true = np.linalg.norm(x[:, None] - x[None, rows], axis=2)
        assert (np.abs(d - true) <= error[rows] + 1e-9).all()
    assert probes.mean() < 0.9


def thue_morse(n):
    """A word over a and b that any sum of bytes times powers takes for its mirror image, and that image."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1, 8, 256, 512, 1024, 4096, 1 << 17])
def test_words_of_one_form_have_different_hashes(n):
    one, two = thue_morse(n)
    other = one[:-1] + "c"
    words = Words(pa.array([one, two, other, one + "a", one]))
    hashes = words.hashes().tolist()
    assert len(set(hashes)) == 4 and hashes[0] == hashes[4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=5), st.integers(0, 9), st.randoms())
def test_hashes_depend_on_the_bytes_only(sizes, shift, rng):
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in sizes]
    texts += [t[:-1] + b"\0" for t in texts if t] + [t + b"\0" for t in texts]

    def hashed(parts, gap):
        data = np.frombuffer(b"x" * gap + b"".join(parts), np.uint8)
        ends = gap + np.cumsum([len(p) for p in parts])
        return span_hashes(data, ends - [len(p) for p in parts], ends).tolist()

    got = hashed(texts, shift)
    assert got == [hashed([t], 0)[0] for t in texts]
    assert len(set(got)) == len(set(texts))


def test_long_words_of_one_form_are_kept_apart(spark):
    one, two = thue_morse(4096)
    start = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [f"{start} {one}", f"{start} {two}", one, two, f"{start} {two}"])
    rows = by_id(substrings.digests(docs))
    assert [rows[i].n_removed for i in range(5)] == [0, 0, 0, 0, 13]
    groups = by_id(jaccard.similar_groups(docs))
    assert [groups[i].component_id for i in range(5)] == [0, 1, 2, 3, 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=40), min_size=1, max_size=6))
def test_signatures_differ_in_no_more_bits_than_sets(sets):
    base = sorted(sets[0])
    sets = [*sets, set(base), set(base[1:]), set(base[::2]) | {5}]
    first = np.cumsum([0] + [len(s) for s in sets])
    signs = jaccard.signatures(first, np.array([x for s in sets for x in sorted(s)], np.uint64)).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum(int(x ^ y).bit_count() for x, y in zip(signs[i], signs[j]))
            assert bits <= len(a ^ b) and bits % 2 == len(a ^ b) % 2


def test_families_of_copies_that_are_too_far_apart_give_few_candidates(spark, monkeypatch):
    """Copies of one text with random edits, most pairs below the limit: what is verified grows slower than the pairs."""
    counts = []
    real = jaccard.similar

    def counting(pairs, texts, k, percent):
        counts[-1].append(pairs.count())
        return real(pairs, texts, k, percent)

    monkeypatch.setattr(jaccard, "similar", counting)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    for n in (200, 800):
        texts = []
        for d in range(n):
            w = list(base)
            for at in rng.sample(range(300), 8):
                w[at] = f"e{d}x{at}"
            texts.append(" ".join(w))
        counts.append([])
        groups = by_id(jaccard.similar_groups(documents(spark, texts, extra=False).repartition(4)))
        if n == 200:
            sets = [{tuple(w[i : i + 3]) for i in range(298)} for w in (t.split() for t in texts)]
            links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
            want = groups_of(range(n), links)
            assert {d: r.component_id for d, r in groups.items()} == want
    few, many = (sum(c) for c in counts)
    assert many < 0.1 * 800 * 799 / 2
    assert few < 0.1 * 200 * 199 / 2 + 800


def test_a_long_word_is_no_leak_of_another_of_its_form(spark):
    one, two = thue_morse(4096)
    items = spark.createDataFrame([(0, two), (1, f"{two} {one} {two}")], "item_id bigint, text string")
    found = decontamination.contaminated(documents(spark, [one, two, f"{one} {one} {one}"]), items)
    assert {(r.doc_id, r.item_id) for r in found.select("doc_id", "item_id").collect()} >= {(1, 0)}
    assert not {(r.doc_id, r.item_id) for r in found.collect()} & {(0, 0), (2, 0)}


def test_lists_grow_with_the_root_of_the_vectors():
    assert [embeddings.lists_for(n) for n in (0, 100, 5_000, 1_000_000, 10**12)] == [2, 2, 6, 83, 512]
