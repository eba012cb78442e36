"""The corpus pipeline and the registered queries."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from check import difference, oracle_over
from tallygrad.llm import queries
from tallygrad.llm.tokens import encoder
from tests.llm.helpers import SCHEMA, prose

SF_DIR = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [prose(rng, 30) for _ in range(4)]
    rows, labels, kind = [], [], {}
    for i in range(160):
        text = prose(rng, rng.randint(30, 90))
        kind[i] = "clean"
        if i % 4 == 0:
            text, kind[i] = text.upper().replace(" ", "!! "), "bad"
        elif i == 101:
            text, kind[i] = rows[1][1], "copy"
        elif i == 102:
            text, kind[i] = rows[2][1] + " " + prose(rng, 2), "copy"
        elif i in (103, 105):
            text, kind[i] = text + " " + items[i % 4], "leak"
        elif i in (106, 107):
            text, kind[i] = text + " write to a.b@mail.example.com or 10.1.2.3", "private"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind[i] != "bad"), 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, kind


def test_stages(spark, tables):
    path, rows, kind = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = {i for i, k in kind.items()}
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ("bad", "copy", "leak", None, None), strict=True):
        docs = stage(spark, docs, path)
        left -= {i for i, k in kind.items() if k == gone}
        got = docs.collect()
        assert sorted(r.doc_id for r in got) == sorted(left), name
        if name != "bpe":
            assert docs.columns == columns
            assert all(r.text == rows[r.doc_id][1] for r in got if name != "personal_data" or kind[r.doc_id] != "private")
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in got}
            assert all(texts[i].endswith(" write to [EMAIL] or [IP]") for i in (106, 107))
            docs = spark.createDataFrame(got, docs.schema)
    for r in got:
        ids = np.array(encoder().tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_run_is_the_stages_one_after_another(spark, tables):
    path, _, kind = tables
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i for i, k in kind.items() if k in ("clean", "private")}


def test_stages_without_rows(spark, tables):
    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_every_operator_has_its_query():
    names = registered.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)


@needs_data
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_its_oracle(spark, name):
    assert difference(spark, oracle_over(SF_DIR), SF_DIR, name) is None


def test_stages_with_awkward_rows(spark, tables):
    """Clashing columns, null and repeated ids, null and empty texts: no stage fails, drops a column or a clean row."""
    path, rows, kind = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clash = ("score", "shingle", "key", "component_id", "node", "item", "packed", "ids", "part", "runs", "label", "a", "b")
    for name in clash:
        docs = docs.withColumn(name, F.lit(name))
    clean = [i for i, k in kind.items() if k == "clean"]
    odd = docs.where(F.col("doc_id") == clean[0])
    docs = (
        docs.union(odd)  # the same row twice
        .union(odd.withColumn("text", F.concat(F.lit("other "), F.reverse("text"))))  # another text under a used id
        .union(docs.where(F.col("doc_id") == clean[1]).withColumn("doc_id", F.lit(None).cast("bigint")))
        .union(odd.withColumns({"doc_id": F.lit(9001).cast("bigint"), "text": F.lit(None).cast("string")}))
        .union(odd.withColumns({"doc_id": F.lit(9002).cast("bigint"), "text": F.lit("")}))
        .repartition(3)
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id").distinct().count()
        out = stage(spark, docs, path)
        rows_out = out.collect()
        if name == "bpe":
            assert len(rows_out) == docs.count()
            break
        assert out.columns == columns
        left = {r.doc_id for r in rows_out}
        if name == "quality":
            # Texts without words may go either way; the others follow their kind.
            assert left - {9001, 9002, None} == {i for i, k in kind.items() if k != "bad"}
        if name == "near_duplicates":
            assert not left & {i for i, k in kind.items() if k == "copy"}
            assert sum(r.doc_id is None for r in rows_out) == docs.where("doc_id is null").count()
        if name == "personal_data":
            assert len(rows_out) == docs.count() and len(left) <= before
        assert all(getattr(r, c) == c for r in rows_out for c in clash)
        docs = spark.createDataFrame(rows_out, docs.schema)
