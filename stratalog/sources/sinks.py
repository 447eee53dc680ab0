"""Sinks: CSV, relational exports, and files of snapshots, changes and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import present
from .files import write_files
from .history import NAMES, History
from .tables import shared_path

#: Quotes double inside quoted texts; an empty text is quoted and so stays apart from a missing one.
_CSV = {"header": "true", "escape": '"', "quoteAll": "false", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_WRITE = _CSV | {"emptyValue": '""'}
#: What a quoted empty text is read as, to tell it from a missing one; no text of ours has these control characters.
_EMPTY = "\x02empty\x03"


def flat(rows: DataFrame) -> DataFrame:
    """Arrays as lists of their present elements with spaces between, structs as columns."""
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(present(F.col(f.name)).cast("array<string>"), " ").alias(f.name))
        elif kind == "struct":
            out += [F.col(f"{f.name}.{n}").alias(f"{f.name}_{n}") for n in f.dataType.names]
        else:
            out.append(F.col(f.name))
    return rows.select(*out)


def into_csv(rows: DataFrame, path: str, single_file: bool = False, headers: list[str] | None = None) -> None:
    """Write rows with a header, by all tasks: the columns' names, or the given ones. single_file is for small results."""
    rows = flat(rows).toDF(*headers) if headers else flat(rows)
    (rows.coalesce(1) if single_file else rows).write.options(**_WRITE).csv(path)


def round_trip_csv(rows: DataFrame) -> DataFrame:
    """Rows written as CSV to the shared folder, and read with their types."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession)
    rows.write.options(**_WRITE, lineSep="\r\n").csv(path)
    read = spark.read.schema(rows.schema).options(**_CSV, emptyValue=_EMPTY, multiLine="true").csv(path)
    return read.select(*[F.when(F.col(c) != _EMPTY, F.col(c)).when(F.col(c) == _EMPTY, "").alias(c) if kind == "string" else F.col(c) for c, kind in read.dtypes])


def ids_from_csv(spark, path: str, column: str) -> DataFrame:
    """The ids in a CSV file's column."""
    return spark.read.option("header", True).csv(path).select(F.col(column).cast("long").alias(column))


def dump(h: History, path: str) -> None:
    """Every entity and mapping once, as CSV, and snapshots' contents as files in the folder blobs."""
    for name in NAMES:
        if name != "snapshots":
            into_csv(h.tables[name].distinct(), f"{path}/{name}")
    into_files(h.snapshots, f"{path}/blobs")


def into_files(snapshots: DataFrame, folder: str) -> DataFrame:
    """One file for each snapshot id; returns the ids skipped for lack of contents."""
    return write_files(snapshots.select("snapshot_id", F.col("snapshot_id").cast("string").alias("name"), "contents"), ["snapshot_id"], folder)


def _with_files(h: History, rows: DataFrame) -> DataFrame:
    """rows (path_id, snapshot_id, ...) with location and contents, missing where there are none."""
    return rows.join(h.paths, "path_id", "left").join(h.snapshots, "snapshot_id", "left")


def changes_into_files(h: History, changes: DataFrame, folder: str) -> DataFrame:
    """Each change's contents at its path, of several changes of a path one. Returns (path_id, snapshot_id) of those skipped,
    as deletions are."""
    last = changes.groupBy("path_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return write_files(_with_files(h, last).withColumnRenamed("location", "name"), ["path_id", "snapshot_id"], folder)


def tree_into_files(h: History, tree: DataFrame, folder: str) -> DataFrame:
    """tree: (commit_id, path_id, snapshot_id). Each file at its path in a folder named by the commit's hash. Returns the
    rows skipped."""
    rows = _with_files(h, tree).join(h.commits.select("commit_id", "hash"), "commit_id", "left")
    return write_files(rows.withColumn("name", F.concat("hash", F.lit("/"), "location")), ["commit_id", "path_id", "snapshot_id"], folder)
