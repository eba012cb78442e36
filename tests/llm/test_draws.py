"""Samples keep their size whatever the table's."""

import pytest
from pyspark.sql import functions as F

from tallygrad.llm import draws, embeddings, language, quality
from tests.llm.helpers import SCHEMA, documents


@pytest.mark.parametrize("there", [2_501, 10**6, 3 * 10**9, 10**12, 10**15])
@pytest.mark.parametrize("rows", [250, 400, 2_500])
def test_the_rate_fits_tables_of_any_size(there, rows):
    expected = draws.bound(there, rows) / draws.HASHES * there
    assert rows <= expected <= 1.21 * rows or there <= 1.2 * rows


def test_draws_follow_the_rate(spark):
    n = 400_000
    ids = spark.range(n)
    for there in (n, 10 * n):
        got = ids.where(draws.drawn(there, 20_000, "id")).count()
        assert abs(got - 24_000 * n / there) < 800 * n / there + 200
        column = ids.withColumn("there", F.lit(there)).where(draws.drawn(F.col("there"), 20_000, "id")).count()
        assert abs(column - got) <= 2
    assert ids.where(draws.drawn(10**12, 2_500, "id")).count() == 0
    assert ids.where(draws.drawn(n, n, "id")).count() == n
    smallest = ids.orderBy(draws.drawn_order("id")).limit(1000).select("id")
    assert smallest.join(ids.where(draws.drawn(n, 1000, "id")), "id").count() == 1000


def test_an_empty_draw_is_an_error(spark, monkeypatch):
    assert draws.not_empty([], 0, "rows") == [] and draws.not_empty([1], 5, "rows") == [1]
    with pytest.raises(RuntimeError, match="no row was drawn from 5 rows"):
        draws.not_empty([], 5, "rows")
    never = lambda *_: F.lit(False)
    docs = documents(spark, ["some words here", "some more of them"], extra=False)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    vectors = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a")], "vec_id bigint, embedding array<double>, label string")
    for module, call in (
        (language, lambda: language.fit(docs)),
        (quality, lambda: quality.fit(docs, labels)),
        (embeddings, lambda: embeddings.near_duplicates(vectors)),
    ):
        monkeypatch.setattr(module, "drawn", never)
        with pytest.raises(RuntimeError, match="no row was drawn"):
            call()


def test_labels_of_any_type_and_many_languages(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y"), (3, [1.0, 2.0], None)]
    text = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    big = text.withColumn("label", F.when(F.col("label") == "x", 2**40).when(F.col("label") == "y", 2**40 + 1))
    for vectors in (text, big):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect()}
        assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}
    dirty = spark.createDataFrame([(i, f"w{i} text", f"l{min(i, 40)}", "s", 5) for i in range(60)], SCHEMA)
    assert len(language.fit(dirty, languages=3).languages) <= 3
    assert "l40" in language.fit(dirty, languages=3).languages


def test_long_segments_are_candidates():
    from tallygrad.llm.personal import _windows

    text = "write to " + "x" * 290 + " @ mail.example.com today"
    (window,) = _windows(text, [])
    whole = [k for k in window.on if text[window.words[k[0]][0] : window.words[k[0] + k[1] - 1][1]] == text[9:-6]]
    assert whole
