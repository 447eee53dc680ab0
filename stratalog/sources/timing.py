"""Times and row counts of the steps of a run."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .sinks import into_csv

_LOG = logging.getLogger("stratalog")


class Timings:
    """Steps of a run, in order: what each wrote, how many rows, and how long it took. Each is logged as it begins and ends."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str, float, int]] = []

    def step(self, name: str, rows: DataFrame, write: Callable[[DataFrame], None]) -> None:
        """write(rows) as a step. Rows are counted on their way; nothing is computed twice."""
        _LOG.info("%s: begins", name)
        seen, began, at = Observation(), time.monotonic(), datetime.now(timezone.utc)
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        took = time.monotonic() - began
        self.steps.append((name, at.strftime("%Y-%m-%dT%H:%M:%S+00:00"), took, seen.get["rows"]))
        _LOG.info("%s: %d rows in %.1f s", name, seen.get["rows"], took)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, began, seconds, rows): one row for each step of the run."""
        return spark.createDataFrame(self.steps, "step string, began string, seconds double, rows long")

    def into_csv(self, spark: SparkSession, path: str) -> None:
        into_csv(self.rows(spark), path, single_file=True)
