"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrad.llm import (
    bpe,
    decontamination,
    embeddings,
    jaccard,
    language,
    licences,
    lines,
    merkle,
    personal,
    quality,
    substrings,
    token_files,
    variants,
)
from tallygrad.llm.store import prepare
from tallygrad.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op3_token_files")
def op3_token_files(spark, sf_dir):
    """Token ids of all documents written to files in doc_id order and read back, with their starts and checksums."""
    path = shared_path(spark, "token-files")
    token_files.write_token_files(token_files.encoded_in_order(table(spark, sf_dir, "documents")), path)
    rows = token_files.with_checksums(token_files.read_token_files(spark, path))
    metadata = token_files.read_token_files(spark, path).select("part", "n_tokens")
    return token_files.with_starts(rows, metadata).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op8_bpe_chunk_reuse")
def op8_bpe_chunk_reuse(spark, sf_dir):
    """Tokens, digest of the ids and of the decoded text of every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.digests())


@register("op10_quality")
def op10_quality(spark, sf_dir):
    """Quality score of every document by a classifier learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).select(
        "doc_id",
        quality.is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@register("op1_language")
def op1_language(spark, sf_dir):
    """Language of every document by a field learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return language.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.is_held_out().alias("held_out"), "lang_pred", "score"
    )


@register("op7_personal_data")
def op7_personal_data(spark, sf_dir):
    """Personal data in every document: counts, digest and spans."""
    docs = table(spark, sf_dir, "documents")
    return personal.find(docs, personal.fit(docs))


@register("op2_licences")
def op2_licences(spark, sf_dir):
    """Licence texts and notices in all documents."""
    return licences.find_licences(table(spark, sf_dir, "documents"))


@register("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    """Documents that hold copies of benchmark items, edited ones too."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Word lists are cut to windows once; DuckDB's space is enough for the tables the oracle runs on.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN least_doc USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
each AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
              FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


@register("op4_substring_dedup", SUBSTRING_SQL)
def op4_substring_dedup(spark, sf_dir):
    """Words of every document without those in windows that a smaller doc_id holds."""
    return substrings.digests(table(spark, sf_dir, "documents"))


# Pairs come from a shared shingle; the words are cut once per document.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@register("op9_jaccard_join", JACCARD_SQL)
def op9_jaccard_join(spark, sf_dir):
    """Groups of documents whose sets of three-word shingles have a similarity of at least 0.9."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / norm) AS e
      FROM (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v) WHERE norm > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
         WHERE list_dot_product(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN link l ON l.a = reach.vec_id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept
FROM reach LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""


@register("op6_embedding_duplicates", EMBEDDING_SQL)
def op6_embedding_duplicates(spark, sf_dir):
    """Links and components of all vectors of one label with a cosine of at least 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM d),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
holder AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT doc_id, line, place, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN holder USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register("op11_line_runs", LINE_SQL)
def op11_line_runs(spark, sf_dir):
    """Lines of every document without those a smaller doc_id holds, in batches against levelled sorted runs."""
    return lines.digests(table(spark, sf_dir, "documents"))


# crc32 of a list of bytes by its table of 256 steps.
CRC_SQL = """
crc_table AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
              FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))"""


def crc_sql(codes: str) -> str:
    """crc32 of a list of byte values, next to ``crc_table``."""
    step = "lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), {step}), 4294967295)"


MERKLE_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, source, concat(
        coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
        coalesce(concat(strlen(lang), ':', lang), '-'),
        coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head, text,
        CASE WHEN {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 2 = 0
             THEN replace(text, chr(10), '') ELSE text END AS other
      FROM documents, crc_table),
leaf AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS h,
                sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(other), ':', other) END)) AS other,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS lvl, i, n, h FROM leaf
       UNION ALL
       SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1
       GROUP BY source, lvl, i // 3, n),
top AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
roof AS (SELECT 0 AS lvl, i, n, h FROM top
         UNION ALL
         SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM roof WHERE n > 1 GROUP BY lvl, i // 3, n),
-- The nodes beside a leaf's path, level by level; a level of the roof counts behind all others.
path AS (SELECT doc_id, up.lvl, up.i, leaf.i // CAST(3 ** up.lvl AS BIGINT) AS own, up.h
         FROM leaf JOIN up ON up.source IS NOT DISTINCT FROM leaf.source AND up.n > 1
              AND up.i // 3 = leaf.i // CAST(3 ** (up.lvl + 1) AS BIGINT)
         UNION ALL
         SELECT doc_id, 1000 + roof.lvl, roof.i, top.i // CAST(3 ** roof.lvl AS BIGINT), roof.h
         FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source
              JOIN roof ON roof.n > 1 AND roof.i // 3 = top.i // CAST(3 ** (roof.lvl + 1) AS BIGINT)),
step AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k,
                coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS before,
                coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS behind
         FROM path GROUP BY doc_id, lvl),
proof AS (SELECT doc_id, sha256(string_agg(concat(before, behind), '' ORDER BY k)) AS p, max(k) AS last FROM step GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS k, other AS h FROM leaf
         UNION ALL
         SELECT f.doc_id, f.k + 1, sha256(concat(before, f.h, behind)) FROM fold f JOIN step s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT leaf.doc_id, leaf.h AS leaf, top.h AS subroot, roof.h AS root, coalesce(p, sha256('')) AS proof_sha256,
       fold.h AS folded_root, fold.h = roof.h AS verified
FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source JOIN roof ON roof.n = 1
     LEFT JOIN proof ON proof.doc_id = leaf.doc_id
     JOIN fold ON fold.doc_id = leaf.doc_id AND fold.k = coalesce(proof.last, 0)
"""


@register("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots, proof and folded root of every document, half of them tampered with."""
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


# Letters up to U+007F are one byte, the others of this range two, of which the first is C3.
RUN_BYTES = """list_concat(list_transform(string_split(concat(doc_id, ':'), ''), lambda x: CAST(ord(x) AS BIGINT)),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)]
                           ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END)))"""
VARIANT_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, {crc_sql(RUN_BYTES)} AS h FROM r, crc_table WHERE length(run) >= 7),
v AS (SELECT word, count(*) AS n
      FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word
            FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
-- A code point replaced: equal but for one place. One put in or taken out: equal without one place.
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM places),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i
         WHERE a.word <> b.word
         UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
         UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
             CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS at, form AS next FROM f
           UNION ALL SELECT follow.word, f.word, f.form FROM follow JOIN f ON f.word = follow.next)
SELECT f.*, follow.at AS root FROM f JOIN follow ON follow.word = f.word AND follow.next IS NULL
"""


@register("op13_spelling_variants", VARIANT_SQL)
def op13_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words, form and root."""
    return variants.variant_groups(variants.words(table(spark, sf_dir, "documents")))
