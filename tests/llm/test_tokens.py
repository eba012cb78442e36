"""Encoding against the tokenizers library itself."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallygrad.llm import bpe, token_files
from tallygrad.llm.text import buffers
from tallygrad.llm.tokens import encoder, gathered
from tests.llm.helpers import awkward_texts, by_id, documents, prose

ALPHABET = " \n\t\r\x0b 　 ᠎\x1c\x85ab1'sZé中!?.,;:|<>" + "x"


def library(texts):
    return [e.ids for e in encoder().tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40) | st.sampled_from(["<|endoftext|>", "a <|endoftext|> b", " don't", "x.\n\n  y"]), max_size=12))
def test_units_give_the_ids_of_whole_texts(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    ids, bounds = encoder().encode(data, offsets)
    assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == library(texts)
    assert encoder().decode(ids).tobytes() == data.tobytes()


def test_memory_is_bounded(monkeypatch):
    from tallygrad.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY_UNITS", 50)
    enc = tokens.Encoder()
    import random

    rng = random.Random(1)
    for _ in range(20):
        texts = [prose(rng, 40)]
        ids, _ = enc.encode(*buffers(pa.array(texts)))
        assert list(ids) == library(texts)[0]
        assert len(enc.young) <= 50 and len(enc.old) <= 120


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=1, max_size=5), st.randoms())
def test_any_chunks_are_repaired(texts, rng):
    """Cuts anywhere between characters, some chunks given and some not."""
    enc = encoder()
    data, offsets = buffers(pa.array(texts, pa.string()))
    starts = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
    cuts = sorted({*offsets.tolist(), *rng.sample(starts, min(len(starts), 6))})
    known = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        if rng.random() < 0.5:
            piece = data[a:b]
            known[a] = enc.encode(piece, np.array([0, len(piece)]))[0].tobytes()
    ids, bounds = bpe.joined_ids(enc, data, offsets, np.array(cuts, np.int64), known)
    assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == library(texts)


def test_chunks_do_not_depend_on_their_place():
    import random

    rng = random.Random(3)
    shared = prose(rng, 3000)
    sets = []
    for texts in ([prose(rng, 400) + " " + shared], ["a b", prose(rng, 77) + " " + shared, ""]):
        data, offsets = buffers(pa.array(texts))
        cuts = bpe.chunk_cuts(data, offsets)
        assert set(offsets.tolist()) <= set(cuts.tolist())
        sizes = np.diff(cuts)
        assert (sizes > 0).all() and sizes.max() <= bpe.LONGEST
        raw = data.tobytes()
        sets.append({raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())})
    assert sum(len(c) for c in sets[0] & sets[1]) > 0.7 * len(shared)


def test_bpe_of_documents(spark):
    import random

    rng = random.Random(8)
    shared = prose(rng, 2000)
    texts = awkward_texts() + [shared + " tail", "head " + shared, shared]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id = 9").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]))
    got = bpe.encode_documents(docs, bpe.digests()).collect()
    assert len(got) == len(texts) + 2
    want = library(texts)
    for r in got:
        ids = np.array(want[9 if r.doc_id is None else r.doc_id], "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        text = encoder().tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_shared_chunks_are_encoded_once(spark):
    """The text of a chunk that several documents hold reaches the encoder at one of them."""
    import random

    shared = prose(random.Random(2), 4000)
    texts = bpe.distinct_texts(documents(spark, [f"{i} {shared}" for i in range(6)]))
    plan = bpe.encode_texts(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(") >= 1
    rows = bpe.encode_texts(texts).collect()
    assert len(rows) == 6


def test_empty_documents_table(spark):
    docs = documents(spark, ["x"]).where("doc_id < 0")
    assert bpe.encode_documents(docs, bpe.digests()).count() == 0


@pytest.fixture()
def token_path(spark, tmp_path):
    docs = documents(spark, awkward_texts() + ["later"]).orderBy("text")
    docs = docs.union(docs.where("doc_id = 7"))
    path = str(tmp_path / "tokens")
    token_files.write_token_files(token_files.encoded_in_order(docs.repartition(3)), path)
    return path


def test_token_files_round_trip(spark, token_path):
    texts = awkward_texts() + ["later"]
    want = [ids + [0] for ids in library(texts)]
    order = [i for i in range(len(texts)) for _ in range(2 if i == 7 else 1)]
    rows = token_files.with_starts(
        token_files.with_checksums(token_files.read_token_files(spark, token_path)), token_files.read_token_files(spark, token_path)
    ).collect()
    rows.sort(key=lambda r: (r.doc_id, r.start))
    start = 0
    for i, r in zip(order, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(want[i]))
        assert r.ids_crc32 == zlib.crc32(np.array(want[i], "<u4").tobytes())
        start += len(want[i])
    offsets = token_files.document_offsets(spark, token_path)
    assert sorted(r.start for r in offsets.collect()) == sorted(r.start for r in rows)
    assert "ids" not in offsets._jdf.queryExecution().executedPlan().toString()


def test_token_files_layout(spark, token_path):
    import pyarrow.parquet as pq

    names = [p for p in __import__("os").listdir(token_path) if p.endswith(".parquet")]
    encodings, indexed = set(), []
    for p in names:
        meta = pq.ParquetFile(f"{token_path}/{p}").metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                indexed.append(column.has_offset_index)
                if "ids" in column.path_in_schema:
                    encodings |= set(column.encodings)
    assert all(indexed) and encodings & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"}
    some = token_files.read_documents(spark, token_path, [3])
    assert [r.doc_id for r in some.collect()] == [3]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString() or "EqualTo(doc_id,3)" in some._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(token_files.encoded_in_order(documents(spark, ["x"]).where("false")), path)
    assert token_files.document_offsets(spark, path).count() == 0


def test_gathered():
    assert gathered(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
