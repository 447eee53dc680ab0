"""Tables that outlive lost executors, and numbers without gaps that no single task hands out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that nothing before it is computed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratalog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a struct for each row that stays the same whenever the row is read again, also for rows that repeat.

    For rows read from Parquet files it is a hash of the file's name (two of a million files share one with a chance of
    3e-8) and the row's number in it; other rows are written with a number first.
    """
    try:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    except AnalysisException:
        return written(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str, rows_per_block: int = 200_000) -> DataFrame:
    """Add `name`: 0, 1, 2, ... without a gap within each group, however large a group is.

    Rows are dealt into blocks by a hash of the ordering columns, numbered within (group, block), and shifted by the
    sizes of the blocks before. The numbering is fixed by the rows alone. No task sees more than a block of a group.
    """
    total = df.count()
    blocks = max(1, -(-total // rows_per_block))
    block, before, rank = f"{name}_block", f"{name}_before", f"{name}_rank"
    dealt = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(*group, block).agg(F.count(F.lit(1)).alias("size"))
    shift = F.coalesce(F.sum("size").over(Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(c).alias(f"{name}_{c}") for c in group], F.col(block).alias(f"{block}_of"), shift.alias(before))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*group, block).orderBy(*order)) - 1)
    same = F.col(block) == F.col(f"{block}_of")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
    return ranked.join(shifts, same).select(*df.columns, (F.col(rank) + F.col(before)).cast("long").alias(name))
