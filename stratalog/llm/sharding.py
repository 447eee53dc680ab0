"""Weighted rendezvous hashing of record keys over shards.

Each record goes to the shard with the least -ln(u) / weight, where u in (0, 1) comes from an MD5 of key and shard. A new
shard takes records only into itself, and each shard gets records in proportion to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """The least score among the shards first, first + 1, ... of these weights, with its shard (ties: the smaller shard)."""
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights, first)])

    def score(shard: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard["shard"].cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / shard["weight"]).alias("score"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))


def shard_records(docs: DataFrame, weights: list[float], grown: float | None = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per record: doc_id, size (UTF-8 bytes plus 16), text_crc32, shard, slot (0, 1, ... within the shard), grown_shard.

    grown: the weight of one more shard; grown_shard is where the record goes then (null for None). Only the id's text and
    the weights decide, so rows that share an id share a shard. A null id counts as the empty key; a null text has no bytes
    and the checksum 0. Slots follow a hash of the id. An empty table gives an empty one. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), rendezvous(key, weights).alias("best"), *([rendezvous(key, [grown], len(weights)).alias("new")] if grown else []))
    grown_shard = F.when(F.col("new.score") < F.col("best.score"), F.col("new.shard")).otherwise(F.col("best.shard")) if grown else F.lit(None).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").cast("int").alias("shard"), grown_shard.cast("int").alias("grown_shard"))
    return numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
