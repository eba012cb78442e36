"""Small tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an be ci do el fa gu hi jo ka lu mi no".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(spark, texts, extra=True, lang="en"):
    """One document per text with ids from 0; with a column whose name operators use inside."""
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "packed", "score", "shingle", "part", "ids", "label", "words"):
            df = df.withColumn(name, F.lit(name))
    return df


def awkward_texts():
    """Null, empty, blank, odd characters, ties, repeats and one very long text."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 60)
    return [
        None,
        "",
        " \n\t ",
        "one",
        "é à ü  x y\r\n 中文 <|endoftext|> it's 'll 12,345.67",
        base,
        base,
        base + " " + prose(rng, 3),
        "same same " * 40,
        long,
        "x" * 5000,
        "Ab\x1cc\x85d 　 e",
    ]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
