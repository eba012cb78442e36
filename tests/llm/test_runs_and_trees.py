"""Line runs, hash trees and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrad.llm import lines, merkle, sha256, variants
from tests.conftest import plan_of
from tests.llm.helpers import SCHEMA, SYLLABLES, awkward_texts, by_id, documents, prose

BLANKS = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_hand(rows, least=10):
    """rows: (doc_id, text)."""
    first = {}
    for d, t in sorted(r for r in ((d, t or "") for d, t in rows if d is not None)):
        for line in t.split("\n"):
            key = line.strip(BLANKS).translate(ASCII_LOWER)
            if len(key) >= least:
                first.setdefault(key, d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        left = [x for x in all_lines if d is None or first.get(x.strip(BLANKS).translate(ASCII_LOWER), d) >= d]
        out.append((d, len(all_lines), len(all_lines) - len(left), "\n".join(left)))
    return out


def line_texts(seed, n=60):
    rng = random.Random(seed)
    common = ["Éa common LINE of Many", "another common line\r", "short", "\x1cnot a blank at its end\x85", prose(rng, 400)]
    made = []
    for _ in range(n):
        own = [prose(rng, rng.randint(0, 6)) for _ in range(rng.randint(0, 5))]
        own += [x.upper() if rng.random() < 0.2 else " " + x + "\t" for x in rng.choices(common, k=rng.randint(0, 4))]
        rng.shuffle(own)
        made.append("\n".join(own))
    return awkward_texts() + made + [made[3], "\n\n", "a common line\n" * 3]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, batches):
    texts = line_texts(batches)
    docs = documents(spark, texts).repartition(3)
    docs = docs.withColumn("hash", F.lit("h")).withColumn("places", F.lit(1)).withColumn("batch", F.lit(7))
    # The same row again, another text under a used id, and a row without an id.
    docs = docs.union(docs.where("doc_id = 20"))
    other = docs.where("doc_id = 21").withColumn("text", F.lit("One Common Line For All\n" + texts[30]))
    docs = docs.union(other).union(docs.where("doc_id = 30").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lines.with_kept_lines(docs, prefix="_", batches=batches, fan=2)
    assert got.columns == [*docs.columns, "_n_lines", "_n_dropped", "_kept_text"]
    found = sorted(((r.doc_id, r._n_lines, r._n_dropped, r._kept_text) for r in got.collect()), key=str)
    want = sorted(lines_by_hand(rows), key=str)
    assert found == want
    assert any(r[2] for r in want)


def test_lines_of_no_documents(spark):
    docs = documents(spark, [])
    assert lines.digests(docs).collect() == []
    assert lines.repeated_lines(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).collect() == []


def test_runs_are_levelled_sorted_and_stay_where_they_are(spark):
    texts = ["a line that is in all of them\n" + f"a line of document {i} alone\n" + f"and one of every third {i % 3}" for i in range(40)]
    docs = documents(spark, texts, extra=False)
    runs = lines.LineRuns(spark, buckets=4, fan=2)
    gone = []
    for i in range(5):
        batch = lines.line_hashes(docs.where(F.col("doc_id").between(8 * i, 8 * i + 7)))
        gone += [(r.doc_id, r.place) for r in runs.add(batch).collect()]
        held = sum(r.count() for r in runs.runs())
        assert held == len({x for t in texts[: 8 * i + 8] for x in t.split("\n")})
    assert sorted(gone) == sorted([(d, 0) for d in range(1, 40)] + [(d, 2) for d in range(3, 40)])
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five runs, two to a level
    for run in runs.runs():
        assert run.inputFiles()
        for file in run.inputFiles():
            hashes = [bytes(r.hash) for r in spark.read.parquet(file).collect()]
            assert hashes == sorted(hashes)
    # A merge with a run moves the batch only.
    batch = lines.line_hashes(docs).groupBy("hash").agg(F.min("doc_id").alias("holder"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = plan_of(batch.join(runs.runs()[0].select("hash").hint("merge"), "hash", "left_anti"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Python" not in plan
    paths = [p.removeprefix("file:") for level in runs.levels for _, p in level]
    runs.close()
    assert not any(spark.catalog.tableExists(t.name) for t in spark.catalog.listTables() if t.name.startswith("line_run")), paths


def test_lines_use_no_python(spark):
    plan = lines.with_kept_lines(documents(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.randoms())
def test_states_of_many_hashes(sizes, rng):
    messages = [[bytes(rng.randrange(256) for _ in range(32)) for _ in range(n)] for n in sizes]
    state = sha256.started(len(sizes))
    for k in range(max(sizes)):
        rows = np.array([i for i, m in enumerate(messages) if k < len(m)])
        digests = np.frombuffer(b"".join(messages[i][k] for i in rows), np.uint8).reshape(-1, 32)
        state[rows] = sha256.compress(state[rows], sha256.hex_block(digests))
    got = sha256.finished(state, np.array(sizes))
    for i, m in enumerate(messages):
        assert got[i].tobytes() == hashlib.sha256("".join(x.hex() for x in m).encode()).digest()


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([hashed(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return found


def folded(value, at, levels):
    siblings = []
    for level in levels[:-1]:
        run = list(level[at // 3 * 3 : at // 3 * 3 + 3])
        siblings += run[: at % 3] + run[at % 3 + 1 :]
        run[at % 3] = value
        value, at = hashed(*run), at // 3
    return value, siblings


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text) without equal ids."""
    trees = {}
    for r in sorted(rows, key=lambda r: r[0]):
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: b"" if s is None else b"=" + s.encode())
    levels = {s: levels_of([leaf_by_hand(r) for r in trees[s]]) for s in names}
    roof = levels_of([levels[s][-1][0] for s in names])
    out = {}
    for at, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            text = r[4]
            if text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            value, proof = folded(leaf_by_hand((*r[:4], text)), i, levels[s])
            value, more = folded(value, at, roof)
            root = roof[-1][0]
            out[r[0]] = (levels[s][0][i], levels[s][-1][0], root, hashed(*proof, *more), value, value == root)
    return out


@pytest.mark.parametrize("sizes", [{"s": 1}, {"s": 3, None: 1}, {"a": 2300, "é": 730, "": 729, None: 28, "b": 4, "c": 1, "=": 2}])
def test_manifest(spark, sizes):
    rng = random.Random(3)
    rows, texts = [], line_texts(5)
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(texts[:9] + texts[10:])
            rows.append((7 * len(rows) % 10_007 - 50, source, rng.choice(("en", None, "dé")), rng.choice((None, 12)), text))
    ids = [r[0] for r in rows]
    assert len(set(ids)) == len(ids)
    named = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA).repartition(5)
    docs = named.withColumn("tree", F.lit("x")).withColumn("place", F.lit(1)).withColumn("digest", F.lit("d"))
    want = manifest_by_hand(rows)
    got = by_id(merkle.verified_documents(docs))
    assert len(got) == len(rows)
    for d, r in got.items():
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == want[d]
    if len(rows) > 10:
        assert {r.verified for r in got.values()} == {True, False}


def test_manifest_of_awkward_tables(spark):
    docs = documents(spark, ["a", "b\nc", "b\nc", None])
    assert merkle.verified_documents(docs.where("false")).collect() == []
    # Rows alike, and rows without an id: every row is a leaf.
    twice = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = merkle.verified_documents(twice).collect()
    assert len(rows) == 12 and len({r.root for r in rows}) == 1
    assert all(r.verified for r in rows if r.doc_id is None)


def runs_by_hand(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("options", [{}, {"longest": 2}, {"share": 0.02, "longest": 6}])
def test_variants(spark, options):
    rng = random.Random(8)
    counts = {}
    stems = ["anbecido", "éllefagu", "x" * 60, "hijokalumi" * 3, "ababababab", "aaaaaaa"]
    for stem in stems:
        counts[stem] = 5000
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice("abné")] * rng.randint(0, 1)
            if len(w) >= 7:
                counts.setdefault("".join(w), rng.choice((2, 3, 30, 400)))
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("key", F.lit(1)).repartition(4)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.variant_groups(table, **options).collect()}
    want = variants_by_hand(counts)
    assert got == want
    assert any(r[2] and r[4] != r[2] for r in want.values())


def test_words(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(3, 6))) for _ in range(20)] + ["Éàlongÿword", "x" * 90]
    texts = awkward_texts()
    for _ in range(30):
        some = [w.upper() if rng.random() < 0.3 else w for w in rng.choices(stems, k=40)]
        texts.append(rng.choice((" ", "\n", "9", "—")).join(some))
    docs = documents(spark, texts).repartition(3)
    docs = docs.union(docs.where("doc_id = 15").withColumn("doc_id", F.lit(None).cast("bigint"))).union(docs.where("doc_id = 16"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = runs_by_hand(rows)
    assert want and {r.word: r.n for r in variants.words(docs).collect()} == want
    assert variants.words(docs.where("false")).collect() == []
    assert variants.variant_groups(variants.words(docs.where("text is null"))).collect() == []


WORDS = st.text("abé", min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=3, max_size=5), max_size=10), WORDS, st.integers(0, 9), st.sampled_from(["", "a", "b", "x"]), st.booleans())
def test_a_pair_shares_the_grams_its_edit_leaves(sequences, word, at, letter, put_in):
    grams = variants.Grams({g[:k] for g in sequences for k in range(3, len(g) + 1)})
    at = min(at, len(word) - 1)
    other = word[:at] + letter + word[at + (not put_in) :]
    if other == word or not other:
        return
    first = next((i for i, (x, y) in enumerate(zip(word, other)) if x != y), min(len(word), len(other)))

    def listed(w, longer):
        """Parts of the word in the list of the first difference."""
        kind = 0 if longer else 1
        return [
            (w[:a], w[len(w) - b :]) for (a, b), places in grams.left_alone(w).items() if places[kind][0] <= first <= places[kind][1]
        ]

    mine, theirs = listed(word, len(word) >= len(other)), listed(other, len(other) >= len(word))
    assert len(mine) == 1 and mine == theirs
