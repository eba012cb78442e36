"""Stored samples: a Parquet store by meter, and the older text form."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.neighbours import NEIGHBOURS, below
from ..operators.readings import select_meters
from ..operators.samples import split_vector
from ..session import remove_path, shared_path

SAMPLES_SCHEMA = "id string, month int, j int, label double, features array<double>"


def parse_sample_text(
    df: DataFrame, max_label: float | None = 1.0, strict: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """(label, features) from lines of comma-separated numbers in column ``value``.

    Keeps lines with exactly seven numbers, empty fields at the end not counted,
    and a label below ``max_label``. A field that is no number is an error, or,
    with ``strict=False``, makes its line disappear.
    """
    line = F.regexp_replace("value", r"[,\s]+$", "")
    fields = F.split(line, ",")
    if strict:
        numbers = F.transform(fields, lambda s: F.trim(s).cast("double"))
    else:
        numbers = F.transform(fields, lambda s: F.trim(s).try_cast("double"))
    sized = df.select(*keep, fields.alias("_fields"), numbers.alias("_numbers"))
    sized = sized.filter(F.size("_fields") == NEIGHBOURS + 1)
    if not strict:
        sized = sized.filter(F.forall("_numbers", lambda v: v.isNotNull()))
    return below(split_vector(sized, "_numbers", keep), max_label)


def read_sample_text(spark: SparkSession, path: str, max_label: float | None = 1.0, strict: bool = True) -> DataFrame:
    """Samples of text files named by meter id: (id, label, features). No file, no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string, label double, features array<double>")
    named = lines.select("value", F.col("_metadata.file_name").alias("id"))
    return parse_sample_text(named, max_label, strict, keep=["id"])


def sample_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Samples as lines ``label,feature,...,`` in column ``value``."""
    values = F.transform(F.concat(F.array("label"), F.col("features")), lambda v: v.cast("string"))
    return df.select(*keep, F.concat(F.concat_ws(",", values), F.lit(",")).alias("value"))


class SampleStore:
    """Parquet samples, hashed by meter id into a fixed number of folders.

    A folder per id would leave millions of tiny files; here looking up a few
    ids reads a few folders, and the number of files does not grow with the
    number of meters. Every write puts its rows into a new folder, below
    ``bucket_of_<count>=<bucket>``, and then a small manifest that lists the
    folders in force for each bucket. A reader follows the newest manifest, so a
    write that breaks off before its manifest changes nothing, and a manifest is
    only created where none of its number exists, so of two writers at once one
    has to start again. The bucket count is part of the manifest; a store opened
    with another one is refused, and so is a path on an object store, which cannot
    do that; keep such samples in a table format. Folders no longer in force stay for readers
    that still use them, until :meth:`vacuum`.
    """

    #: Object stores whose rename is a copy and replaces what is there, so that two writers could both win.
    NO_RENAME = ("s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "obs", "swift", "wasb", "wasbs")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        scheme = path.partition(":/")[0].lower() if ":/" in path else ""
        if scheme in self.NO_RENAME:
            raise ValueError(f"a sample store needs a file system with a rename that never replaces; {scheme} has none")
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.bucket_column = f"bucket_of_{buckets}"

    def _bucket(self, ident: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(ident), F.lit(self.buckets)).cast("int")

    # ---- manifests: small JSON files on the driver's side, through Spark's file system

    def _file(self, name: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(context._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict[int, list[str]]]:
        """(number, folders by bucket) of the newest manifest; 0 and none before the first write."""
        folder, system = self._file("_manifests")
        if not system.exists(folder):
            return 0, {}
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if number == 0:
            return 0, {}
        text = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        target, system = self._file(f"_manifests/{number}")
        stream = system.open(target)
        try:
            found = json.loads(bytes(text.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()
        if found["buckets"] != self.buckets:
            raise ValueError(f"store has {found['buckets']} buckets, opened with {self.buckets}")
        return number, {int(b): folders for b, folders in found["folders"].items()}

    def _commit(self, number: int, folders: dict[int, list[str]]) -> bool:
        """Put a manifest in force; False when another writer was first.

        The content is written aside and renamed into place, which never
        replaces a file that exists.
        """
        self._file("_manifests")[1].mkdirs(self._file("_manifests")[0])
        aside, system = self._file(f"_manifests/.{number}-{uuid.uuid4().hex}")
        stream = system.create(aside, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        stream.close()
        target, _ = self._file(f"_manifests/{number}")
        done = not system.exists(target) and system.rename(aside, target)
        if not done:
            system.delete(aside, False)
        return done

    # ---- reading

    def _rows(self, folders: dict[int, list[str]], buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = [f for b, fs in sorted(folders.items()) if buckets is None or b in buckets for f in fs]
        if not wanted:
            return self.spark.createDataFrame([], SAMPLES_SCHEMA)
        return self.spark.read.schema(SAMPLES_SCHEMA).parquet(*[f"{self.path}/{f}" for f in wanted])

    def _buckets_of(self, ids: DataFrame) -> list[int]:
        """Buckets that hold the ids: at most as many numbers as there are buckets."""
        return [r.b for r in ids.select(self._bucket().alias("b")).where(F.col("b").isNotNull()).distinct().collect()]

    def read(self, ids: str | Sequence[str] | DataFrame | None = None, max_label: float | None = None) -> DataFrame:
        """Stored samples of all or the wanted meters; reads their folders only."""
        _, folders = self._manifest()
        if ids is None:
            return below(self._rows(folders), max_label)
        if isinstance(ids, DataFrame):
            rows = self._rows(folders, self._buckets_of(ids))
            return below(rows.join(ids.select("id").distinct(), "id", "left_semi"), max_label)
        listed = [ids] if isinstance(ids, str) else list(ids)
        table = self.spark.createDataFrame([(i,) for i in listed], "id string")
        return below(select_meters(self._rows(folders, self._buckets_of(table)), listed), max_label)

    # ---- writing

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """New folders of the rows by bucket."""
        version = f"data-{uuid.uuid4().hex}"
        placed = rows.select("id", "month", "j", "label", "features").withColumn(self.bucket_column, self._bucket())
        # rebalance: rows of a folder go to few tasks, yet a large folder is split by size.
        # Sorted by id, a look-up skips most row groups of the folders it reads.
        ordered = placed.hint("rebalance", self.bucket_column).sortWithinPartitions(self.bucket_column, "id", "month", "j")
        ordered.write.partitionBy(self.bucket_column).parquet(f"{self.path}/{version}")
        folder, system = self._file(version)
        made = [status.getPath().getName() for status in system.listStatus(folder)]
        return {int(n.split("=")[1]): f"{version}/{n}" for n in made if n.startswith(f"{self.bucket_column}=")}

    def save(self, samples: DataFrame, attempts: int = 5) -> None:
        """Store samples, replacing all earlier ones of the same meters.

        Rows of other meters in the same buckets are carried over into the new
        folders; other buckets stay untouched. The samples are worked out once,
        into the shared folder.
        """
        work = shared_path(self.spark, "samples-to-save")
        samples.select("id", "month", "j", "label", "features").write.parquet(work)
        try:
            rows = self.spark.read.schema(SAMPLES_SCHEMA).parquet(work)
            ids = rows.select("id").distinct()
            touched = self._buckets_of(ids)
            for _ in range(attempts):
                number, folders = self._manifest()
                others = self._rows(folders, touched).join(ids, "id", "left_anti")
                new = self._write(others.unionByName(rows))
                kept = {b: f for b, f in folders.items() if b not in touched}
                if self._commit(number + 1, kept | {b: [f] for b, f in new.items()}):
                    return
            raise RuntimeError("other writers were always first")
        finally:
            remove_path(self.spark, work)

    def missing(self, ids: DataFrame) -> DataFrame:
        """Those of the wanted ids for which no sample is stored."""
        wanted = ids.select("id").distinct()
        held = self._rows(self._manifest()[1], self._buckets_of(wanted)).select("id").distinct()
        return wanted.join(held, "id", "left_anti")

    def get_or_build(
        self, ids: DataFrame, build: Callable[[DataFrame], DataFrame], max_label: float | None = None
    ) -> DataFrame:
        """Stored samples of the wanted meters, building and storing those not held.

        ``build`` gets the table of missing ids, which is worked out once. Two
        callers at once may both build a meter; as saving replaces meters, it is
        stored once. ``max_label`` applies to stored and new samples alike.
        """
        work = shared_path(self.spark, "wanted-meters")
        self.missing(ids).write.parquet(work)
        try:
            missing = self.spark.read.schema("id string").parquet(work)
            if not missing.isEmpty():
                self.save(build(missing))
        finally:
            remove_path(self.spark, work)
        return self.read(ids, max_label)

    def vacuum(self) -> None:
        """Remove folders that the newest manifest does not list; only while nobody reads or writes."""
        number, folders = self._manifest()
        held = {f.split("/")[0] for fs in folders.values() for f in fs}
        root, system = self._file("")
        for status in system.listStatus(root) if system.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("data-") and name not in held:
                system.delete(status.getPath(), True)
