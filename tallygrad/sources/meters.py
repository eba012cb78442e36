"""Monthly meter files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The fields of a reading and their names in the files.
FIELDS = {
    "id": ("id", "string"),
    "bar_code": ("barCode", "string"),
    "date": ("date", "string"),
    "total": ("total", "double"),
    "fee1": ("fee1", "double"),
    "fee2": ("fee2", "double"),
}
MONTH_IN_PATH = r"(\d{6})\.csv"
# An empty host may be written or left out.
_NO_HOST = "^([A-Za-z][A-Za-z0-9+.-]*):///"


def typed_records(df: DataFrame, names: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The six fields of a reading in their types; other columns are dropped.

    ``names`` maps fields to source columns. Text that is no number becomes NULL.
    """
    names = {field: source for field, (source, _) in FIELDS.items()} | dict(names or {})
    fields = [F.col(f"`{names[f]}`").try_cast(kind).alias(f) for f, (_, kind) in FIELDS.items()]
    return df.select(*fields, *keep)


def month_of_file(pattern: str = MONTH_IN_PATH) -> Column:
    """The month (yyyymm) a row belongs to, taken from the path of its file; a path without one is an error."""
    path = F.col("_metadata.file_path")
    month = F.regexp_extract(path, pattern, 1).try_cast("int")
    return F.coalesce(month, F.raise_error(F.concat(F.lit(f"no month by {pattern} in "), path)))


def _parts(uri: str) -> tuple[str, str, str]:
    """Scheme, authority and encoded path; file:/x and file:///x are the same place."""
    found = urlsplit(uri)
    return found.scheme, found.netloc, found.path.rstrip("/")


def resolved(spark: SparkSession, path: str) -> list[str]:
    """Files and folders a path or pattern stands for, as full URIs the way Spark writes them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [status.getPath().toUri().toString() for status in found or []]


def months_of_files(files: Sequence[str], roots: Mapping[str, int] | Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    """(file, month) for URIs of files: the month of the listed file or folder that the file is, or lies below.

    A file that is listed with two months, or with none, is an error.
    """
    listed: dict[tuple[str, str, str], set[int]] = {}
    for uri, month in roots.items() if isinstance(roots, Mapping) else roots:
        listed.setdefault(_parts(uri), set()).add(int(month))
    found = []
    for file in dict.fromkeys(files):
        scheme, host, path = _parts(file)
        ends = [i for i, c in enumerate(path) if c == "/"] + [len(path)]
        months = set().union(*(listed.get((scheme, host, path[:end]), ()) for end in ends))
        if len(months) != 1:
            raise ValueError(f"{'several months are' if months else 'no month is'} listed for {file}: {sorted(months)}")
        found.append((file, months.pop()))
    return found


def _with_listed_month(lines: DataFrame, paths: Sequence[str], months: Sequence[int]) -> DataFrame:
    """Add ``month`` by joining the exact file of a row with the listed months; Spark broadcasts the list by its size."""
    spark = lines.sparkSession
    roots = [(uri, month) for path, month in zip(paths, months) for uri in resolved(spark, path)]
    name = "_" + max([*lines.columns, "file"], key=len)  # no column of the files
    found = months_of_files([re.sub(_NO_HOST, r"\1:/", file) for file in lines.inputFiles()], roots)
    # As Arrow the list is part of the plan with its size, as rows it would be a scan of unknown size.
    columns = [pa.array([file for file, _ in found], pa.string()), pa.array([m for _, m in found], pa.int32())]
    listed = spark.createDataFrame(pa.Table.from_arrays(columns, names=[name, "month"]))
    rows = lines.withColumn(name, F.regexp_replace("_metadata.file_path", _NO_HOST, "$1:/")).join(listed, name, "left")
    unknown = F.raise_error(F.concat(F.lit("no month is listed for "), F.col(f"`{name}`")))
    return rows.withColumn("month", F.coalesce("month", unknown)).drop(name)


def read_meter_csv(
    spark: SparkSession,
    paths: Sequence[str],
    months: Sequence[int] | None = None,
    month_pattern: str = MONTH_IN_PATH,
    header: Sequence[str] | None = None,
    one_header: bool = True,
) -> DataFrame:
    """Readings of CSV files with header lines: the six fields and ``month``.

    Months come from the files, not from the date column: by position where
    ``months`` lists one per path, else from the path. A path may be a file, a
    folder or a pattern; what it stands for is looked up once, and rows are joined
    by their exact file. Files without a month, or listed with two, are an error. No types are inferred; beforehand only the header line of the
    first path is looked at, and none where ``header`` gives the column names.
    All paths are one scan that reads the needed columns and refuses a file with
    another header. With ``one_header=False`` every path's header is looked at,
    and paths with the same one share a scan.
    """
    if isinstance(paths, str):
        paths = [paths]
    if months is not None and len(months) != len(paths):
        raise ValueError("months must list one month per path")
    def header_of(path: str) -> tuple:
        return tuple(header or spark.read.option("header", True).csv(path).columns)

    scans: dict[tuple, list[str]] = {}
    shared = header_of(paths[0]) if one_header else None
    for path in paths:
        scans.setdefault(shared or header_of(path), []).append(path)
    position = dict(zip(paths, range(len(paths))))
    if months is not None and any(months[position[p]] != m for p, m in zip(paths, months)):
        raise ValueError("several months are listed for one path")
    parts = []
    for names, group in scans.items():
        schema = StructType([StructField(name, StringType()) for name in names])
        lines = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(group)
        if months is None:
            lines = lines.withColumn("month", month_of_file(month_pattern))
        else:
            lines = _with_listed_month(lines, group, [months[position[p]] for p in group])
        parts.append(typed_records(lines, keep=["month"]))
    return reduce(DataFrame.unionByName, parts)
