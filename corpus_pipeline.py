"""From raw documents to token counts: five stages, each a table of its own.

Each stage works on all rows its predecessor kept and returns the columns it
got, the last one what BPE gives for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrad.llm import bpe, decontamination, jaccard, personal, quality
from tallygrad.llm.store import kept, prepare

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.7
#: Words of a shingle and least similarity of near copies in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on the labelled ones among them."""
    prepare(spark)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    name = "_" + max(docs.columns, key=len)  # no column of docs
    scored = quality.with_score(docs, model, name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    prepare(spark)
    groups = jaccard.similar_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    copies = kept(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    prepare(spark)
    found = decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    leaks = kept(found.select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    prepare(spark)
    return personal.mask(docs, personal.fit(docs)).select(docs.columns)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    prepare(spark)
    return bpe.encode_documents(docs, bpe.digests())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("personal_data", masked_documents),
    ("bpe", encoded_documents),
]

#: No SQL: the first stage is a learned model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage but the last is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
