"""Tables written to the folder that driver and executors share, to cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, gone when the driver ends. Where that is unset, a session on one machine,
    as in tests, gets a temporary one; on a cluster, where each machine would write to its own, that is an error."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/stratalog-{context.applicationId}"
    if getattr(context, "_stratalog_folder", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        context._stratalog_folder = folder
    return folder


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """As materialized, in buckets by key: joins over it and groups of it move only the other side. By default there are as many as
    a shuffle has partitions."""
    spark, name = df.sparkSession, f"history_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", shared_path(spark)).saveAsTable(name)
    return spark.table(name)


def distinct_of(rows: DataFrame, source: DataFrame, most: int = 500_000) -> DataFrame:
    """The distinct rows of what comes of a source, dealt as by dealt_by."""
    return dealt_by(rows, rows.columns, source, most).distinct()


def dealt_by(rows: DataFrame, columns: list[str], source: DataFrame, most: int = 500_000) -> DataFrame:
    """What comes of a source, in ranges of these columns, for groups of all of them. The rows are dealt over more tasks the more rows the
    source has, about `most` of them for each, so that what a task holds doesn't grow with the table. As one value of the first column
    is in one task, or in a few that follow each other, figures by it are summed before they move."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + source.count() // most)
    return rows.repartitionByRange(parts, *columns)


class Lazy(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)
