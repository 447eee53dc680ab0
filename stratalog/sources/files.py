"""Files with given names, written by all tasks of a job and seen only when the whole job has succeeded.

Each attempt of a task writes below a folder of its own. If all tasks succeed, a manifest names the attempts that count; those of
failed, repeated or doubled tasks are not in it. A second job then moves the files of these attempts to their places, each by
one rename, which can be done again without harm. If the first job fails, all of its attempts are removed.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shipping import ship
from .tables import materialized

_NAMES, _SKIPPED, _MANIFEST = "_names", "_skipped", "_manifest"


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class FilesWriter(DataSourceArrowWriter):
    """Rows (key, name, contents): a file for each with a name inside the folder and contents; the keys of the others are listed."""

    def __init__(self, attempts: str):
        self.attempts = attempts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        top = Path(self.attempts) / attempt
        (top / "files").mkdir(parents=True)
        with (top / _NAMES).open("w") as names, (top / _SKIPPED).open("w") as skipped:
            for batch in iterator:
                for key, name, contents in zip(*(batch.column(c) for c in ("key", "name", "contents")), strict=True):
                    name = name.as_py()
                    if name is None or not contents.is_valid or not name.strip("/.") or name.startswith("/") or "\0" in name or ".." in name.split("/"):
                        skipped.write(key.as_py() + "\n")
                        continue
                    at = top / "files" / name
                    at.parent.mkdir(parents=True, exist_ok=True)
                    at.write_bytes(contents.as_py())
                    names.write(json.dumps(name) + "\n")
        return Attempt(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        top = Path(self.attempts)
        top.mkdir(parents=True, exist_ok=True)
        (top / "_new").write_text(json.dumps([m.name for m in messages if m]))
        os.replace(top / "_new", top / _MANIFEST)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


class FilesSource(DataSource):
    """The format stratalog_files, with the option attempts: the folder of a job's attempts."""

    @classmethod
    def name(cls) -> str:
        return "stratalog_files"

    def schema(self) -> str:
        return "key string, name string, contents binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(self.options["attempts"])


def _moved(folder: str, attempts: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Move an attempt's files to their places; gives the keys of what it skipped."""
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                top = Path(attempts) / attempt
                with (top / _NAMES).open() as names:
                    for line in names:
                        name = json.loads(line)
                        source, target = top / "files" / name, Path(folder) / name
                        target.parent.mkdir(parents=True, exist_ok=True)
                        if source.exists() or not target.exists():  # else an earlier try has moved it
                            os.replace(source, target)
                with (top / _SKIPPED).open() as skipped:
                    for line in skipped:
                        yield pa.RecordBatch.from_pydict({"key": [line.rstrip("\n")]})

    return move


def write_files(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Write rows (keys..., name, contents) as files of a folder that all tasks and the driver can write, such as a mounted one.

    Returns the keys of the rows skipped: those without a name or contents, and those whose name leads out of the folder. They
    are also added to the folder _skipped, as JSON. Of rows with one name the file of any is kept. If a task fails for good,
    no file is left.
    """
    spark, folder = rows.sparkSession, os.path.abspath(folder)
    ship(spark)
    spark.dataSource.register(FilesSource)
    attempts = f"{folder}/_attempts/{uuid.uuid4().hex}"
    kinds = rows.select(*keys).schema
    keyed = rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), "name", F.col("contents").cast("binary").alias("contents"))
    keyed.write.format("stratalog_files").option("attempts", attempts).mode("append").save()
    done = json.loads((Path(attempts) / _MANIFEST).read_text())
    moves = spark.createDataFrame([(a,) for a in done], "attempt string").repartition(max(1, len(done)))
    skipped = materialized(moves.mapInArrow(_moved(folder, attempts), "key string"))
    skipped = skipped.select(F.from_json("key", _ddl(kinds)).alias("k")).select("k.*")
    skipped.write.mode("append").json(f"file://{folder}/{_SKIPPED}")
    shutil.rmtree(attempts, ignore_errors=True)
    return skipped


def _ddl(kinds) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
