"""Sending the package to the executors, and batches of a size that texts need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows that Spark hands to Python at once, where the session doesn't say: a task holds a batch several times over, and rows
#: here are whole texts, not the small records that Spark's own 10,000 is for.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ship(spark: SparkSession) -> None:
    """Add the package to what the session's Python workers can import, once for each Spark context."""
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)
    context = spark.sparkContext
    if getattr(context, "_stratalog_shipped", False):
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp()) / "stratalog.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._stratalog_shipped = True
