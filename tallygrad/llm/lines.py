"""Lines that an earlier document holds already, dropped with levelled sorted runs of line hashes.

A run is a Parquet table of line hashes, bucketed and sorted by hash. A batch of
documents gives its lines' hashes once (map-side partials, so a line of a third
of all documents is one row per task), merge-anti-joins them with the runs there
are, bucket by bucket and without moving the runs, and adds what is left as a
run of its own. Whenever a level holds ``fan`` runs they are merged into one run
of the next level, so n batches are met by some log n runs. Everything is
DataFrame functions; the driver sees run names and batch bounds only.

Defined results: a null or empty text is one empty line; lines whose key is
shorter than ``least`` code points always stay; a line that one document holds
several times stays as often as it is there; rows with the same ``doc_id`` are
one document; rows without a ``doc_id`` hold nothing and lose nothing; columns
other than ``doc_id`` and ``text`` stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrad.llm.store import kept
from tallygrad.session import remove_path, shared_path

#: Code points that a line's key needs at least, so that short common lines stay.
LEAST_POINTS = 10
#: Batches a whole table is taken in, and runs of a level that are merged into one of the next.
BATCHES, FAN = 4, 3

BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Sorted scans of bucketed tables keep their order, so that merge joins sort nothing again.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def split_lines(text: Column) -> Column:
    """The lines of a text, split at \\n; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _digest() -> Column:
    """Tells rows with the same id and other texts apart."""
    return F.xxhash64("text")


def line_hashes(docs: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """(doc_id, digest, place, hash) of all lines with a long enough key: 128 bits of SHA-256, place from 0."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", _digest().alias("digest"), F.posexplode(split_lines(F.col("text"))).alias("place", "line")
    )
    keyed = lines.select("doc_id", "digest", "place", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least).select(
        "doc_id", "digest", "place", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("hash")
    )


class LineRuns:
    """Levelled sorted runs of the line hashes seen so far.

    ``add`` takes the line hashes of one batch and gives the lines in it that are
    not the first: those in a run already, and those of a smaller ``doc_id`` in the
    same batch. Batches may come in any order; with ascending ids the smallest id
    keeps a line. ``buckets`` is that of all runs and by default the session's
    number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: By level: (table, path) of its runs.
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, lines: DataFrame, name: str = "repeated-lines") -> DataFrame:
        """Lines (doc_id, digest, place) of the batch that go, as a written table; its new hashes become a run."""
        with _setting(self.spark, _SORTED_SCANS, "true"):
            fresh = lines.groupBy("hash").agg(F.min("doc_id").alias("holder"))
            for run in self.runs():
                fresh = fresh.join(run.select("hash").hint("merge"), "hash", "left_anti")
            added = self._written(fresh, 0)
            # Both columns are the key, so the rows of a very common line spread over the tasks.
            first = self.spark.table(added[0]).select("hash", F.col("holder").alias("doc_id"))
            gone = kept(lines.join(first, ["hash", "doc_id"], "left_anti").select("doc_id", "digest", "place"), name)
            self._compact()
        return gone

    def _written(self, rows: DataFrame, level: int) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, "line-run")
        writer = rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        return name, path

    def _compact(self) -> None:
        """Merge full levels; their runs share no hash, so a merge is a union."""
        level = 0
        while level < len(self.levels):
            if len(runs := self.levels[level]) >= self.fan:
                rows = reduce(DataFrame.unionByName, [self.spark.table(name) for name, _ in runs])
                self._written(rows.repartition(self.buckets, "hash"), level + 1)
                self.levels[level] = []
                self._drop(runs)
            level += 1

    def _drop(self, runs) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, path)

    def close(self) -> None:
        """Remove all runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def repeated_lines(docs: DataFrame, least: int = LEAST_POINTS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, digest, places) for every row that loses lines: the places of lines a smaller ``doc_id`` holds.

    The table is taken in ``batches`` ranges of ascending ids, bounds by approximate
    quantiles; the lines' hashes are written once, a folder per batch.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", shares, 0.01) if shares else []
    batch = reduce(lambda n, b: n + (F.col("doc_id") > F.lit(b)).cast("int"), sorted(set(bounds)), F.lit(0))
    path = shared_path(spark, "line-hashes")
    hashes = line_hashes(docs, least).withColumn("batch", batch)
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    runs = LineRuns(spark, fan=fan)
    try:
        gone = [runs.add(hashes.where(F.col("batch") == i).drop("batch")) for i in range(len(set(bounds)) + 1)]
    finally:
        runs.close()
    remove_path(spark, path)
    rows = reduce(DataFrame.unionByName, gone)
    return rows.groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places"))


def with_kept_lines(docs: DataFrame, prefix: str = "", **options) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, the lines that stay joined by \\n (new names take ``prefix``)."""
    gone = repeated_lines(docs, **options)
    # What docs may call its columns does not matter: they travel as one struct.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", _digest().alias("digest"))
    joined = rows.join(gone, ["doc_id", "digest"], "left")
    lines = split_lines(F.col("row.text"))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), "places")
    whole = F.col("places").isNull()
    texts = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    parted = joined.select("row", "places", lines.alias("lines"))
    return parted.select(
        "row.*",
        n.cast("long").alias(f"{prefix}n_lines"),
        F.when(whole, 0).otherwise(F.size("places")).cast("long").alias(f"{prefix}n_dropped"),
        F.when(whole, F.coalesce("row.text", F.lit(""))).otherwise(texts).alias(f"{prefix}kept_text"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of every document."""
    kept_rows = with_kept_lines(docs.select("doc_id", "text"))
    return kept_rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
