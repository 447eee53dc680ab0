"""Several stores as one, and a layout in which single entities are found without a scan.

Stores number their entities by themselves, so the same number means different things in two of them. Entities are the same
if their content is: commits by hash, users by address, paths by location, projects by URL, snapshots by the SHA-256 of their bytes.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import Blocks
from .history import NAMES, History
from .tables import Lazy, materialized

#: Of each kind of entity: its table, its id, and what tells it from others.
_ENTITIES = {
    "project": ("projects", "project_id", lambda: F.col("url")),
    "commit": ("commits", "commit_id", lambda: F.col("hash")),
    "user": ("users", "user_id", lambda: F.col("email")),
    "path": ("paths", "path_id", lambda: F.col("location")),
    "snapshot": ("snapshots", "snapshot_id", lambda: F.sha2(F.col("contents").cast("binary"), 256)),
}
#: The kind of entity that each column of a table refers to.
_REFERENCES = {
    "projects": {"project_id": "project"}, "project_metadata": {"project_id": "project"}, "project_logs": {"project_id": "project"}, "project_heads": {"project_id": "project", "commit_id": "commit"},
    "commits": {"commit_id": "commit", "committer_id": "user", "author_id": "user"}, "commit_parents": {"commit_id": "commit", "parent_id": "commit"},
    "commit_changes": {"commit_id": "commit", "path_id": "path", "snapshot_id": "snapshot"}, "paths": {"path_id": "path"}, "users": {"user_id": "user"}, "snapshots": {"snapshot_id": "snapshot"},
}
#: What is one row in the result, if several stores have it; and of entities their id.
_ONE = {"project_metadata": ["project_id"], "commit_parents": ["commit_id", "pos"], "commit_changes": ["commit_id", "path_id"]}


def _referred(h: History, kind: str) -> list[DataFrame]:
    """(old): the ids of a kind that the tables of a store name, those of the kind's own table aside."""
    return [h.tables[name].select(F.col(c).cast("long").alias("old")) for name, refs in _REFERENCES.items() for c, k in refs.items() if k == kind and name != _ENTITIES[kind][0]]


def entity_ids(stores: list[History], kind: str) -> DataFrame:
    """(store, old, id, first): a number for each entity of a kind, without gaps from 1, the same for the same content in all stores;
    `first` where it is named first, by store and then by number.

    Numbers follow the content. An id whose entity is in no table, or has no content to go by, is an entity of its own.
    """
    name, key, content = _ENTITIES[kind]
    parts = []
    for k, h in enumerate(stores):
        known = h.tables[name].select(F.col(key).cast("long").alias("old"), content().alias("content"))
        named = [ids.withColumn("content", F.lit(None).cast("string")) for ids in _referred(h, kind)]
        each = reduce(DataFrame.unionByName, named, known).where("old IS NOT NULL").groupBy("old").agg(F.min("content").alias("content"))
        own = F.struct(F.lit(k).alias("store"), F.col("old").alias("old"))
        parts.append(each.select(F.lit(k).alias("store"), "old", F.struct(F.col("content").isNull().alias("none"), "content", F.when(F.col("content").isNull(), own).alias("own")).alias("same")))
    # Sorted over the cluster once, with their contents; what is summed then are marks of the first of each, in the order they have got.
    every = reduce(DataFrame.unionByName, parts).repartitionByRange("same")
    marked = every.withColumn("first", F.row_number().over(Window.partitionBy("same").orderBy("store", "old")) == 1)
    placed = marked.select(F.lit(0).alias("all"), "store", "old", "first", F.monotonically_increasing_id().alias("_row"))
    return materialized(Blocks.sorted(placed, ["all"]).running("id", F.col("first").cast("long")).select("store", "old", "id", "first"))


class Merged(History):
    """What merged() gives."""

    def __init__(self, stores: list[History]):
        self.stores, self.ids = stores, Lazy({kind: lambda kind=kind: entity_ids(stores, kind) for kind in _ENTITIES})
        make = lambda name: lambda: materialized(self.columns(name)) if name in ("project_heads", "commit_parents") else self.columns(name)
        super().__init__(Lazy({name: make(name) for name in NAMES}))

    def columns(self, name: str, *columns: str) -> DataFrame:
        """A table with only these columns (by default all); what the others refer to is neither numbered nor joined."""
        return _merged_table(self.stores, self.ids, name, list(columns))


def merged(stores: list[History]) -> Merged:
    """One history of several stores. Of an entity that several have, the row of the first store counts (of several ids there, the
    least one's); a project's logs and heads are those of all stores, each once. Columns that a store lacks are null.

    Tables are made when they are first asked for. The graph's are written; the others are plans, so that only the columns
    that someone reads move.
    """
    return Merged(stores)


def _merged_table(stores: list[History], ids: Mapping[str, DataFrame], name: str, columns: list[str]) -> DataFrame:
    keyed = {table: key for table, key, _ in _ENTITIES.values()}
    if not (columns and (name in keyed or name in _ONE)):  # rows that count once as a whole are needed whole
        asked, columns = columns, stores[0].tables[name].columns
    else:
        asked, columns = columns, list(dict.fromkeys([*([keyed[name]] if name in keyed else _ONE[name]), *columns]))
        stores = [History(ChainMap({name: h.tables[name].select(*[c for c in h.tables[name].columns if c in columns])}, h.tables)) for h in stores]
    parts = []
    for k, h in enumerate(stores):
        rows = h.tables[name]
        for column, kind in _REFERENCES[name].items():
            if column not in columns:
                continue
            new = ids[kind].where(F.col("store") == k).select(F.col("old").alias("_old"), F.col("id").alias("_id"), F.col("first").alias("_first"))
            rows = rows.join(new, F.col(column) == F.col("_old"), "left")
            if keyed.get(name) == column:  # one row for each entity: that of the id named first. Rows of an id are together here
                rest = [c for c in rows.columns if c not in (column, "_old", "_id", "_first")]
                rows = rows.where("_first OR _id IS NULL").groupBy(column, "_id").agg(F.min(F.struct(*rest) if rest else F.lit(None)).alias("_row")).select("_id", *[F.col("_row")[c].alias(c) for c in rest]).withColumnRenamed("_id", column)
            else:
                rows = rows.withColumn(column, F.col("_id")).drop("_old", "_id", "_first")
        parts.append(rows.withColumn("_store", F.lit(k)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if name in keyed:
        return whole.select(*(asked or columns))
    if name not in _ONE:
        return whole.select(*columns).distinct().select(*(asked or columns))
    rest = [c for c in whole.columns if c not in (*_ONE[name], "_store")]
    # Dealt by the first of the columns, by which these tables are joined: they move once.
    rows = whole.repartition(_ONE[name][0]).groupBy(*_ONE[name])
    first = rows.agg(F.min(F.struct("_store", *rest)).alias("_first")) if rest else rows.agg(F.min("_store").alias("_first"))
    return first.select(*[c if c in _ONE[name] else F.col("_first")[c].alias(c) for c in asked or columns])


_BLOCK = "id_block"


def write_by_id(h: History, path: str, ids_per_block: int = 1_000_000) -> None:
    """All tables at path/NAME.parquet, those of entities in folders of `ids_per_block` ids each, sorted by id, in small row groups with
    Bloom filters of id and hash, as large as a folder's ids need."""
    keyed = {name: key for name, key, _ in _ENTITIES.values()}
    for name in NAMES:
        rows = h.tables[name]
        if name not in keyed:
            rows.write.parquet(f"{path}/{name}.parquet")
            continue
        key = keyed[name]
        blocked = rows.withColumn(_BLOCK, F.floor(F.col(key) / ids_per_block)).repartitionByRange(key).sortWithinPartitions(_BLOCK, key)
        out = blocked.write.partitionBy(_BLOCK).option("parquet.block.size", 8 << 20)
        for column in (key, "hash"):
            if column in rows.columns:  # without a number, a filter takes a megabyte in each file, however few ids are in it
                out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", ids_per_block)
        out.parquet(f"{path}/{name}.parquet")


class ById(History):
    """A history that write_by_id has written: by_id reads one folder, of it the row groups that can hold the id."""

    def __init__(self, tables: Mapping[str, DataFrame], ids_per_block: int = 1_000_000):
        self.blocked, self.ids_per_block = tables, ids_per_block
        super().__init__(Lazy({name: lambda name=name: tables[name].drop(_BLOCK) for name in tables}))

    @classmethod
    def at_path(cls, spark: SparkSession, path: str, ids_per_block: int = 1_000_000) -> ById:
        return cls(Lazy({name: lambda name=name: spark.read.parquet(f"{path}/{name}.parquet") for name in NAMES}), ids_per_block)

    def by_id(self, table: str, id: int) -> DataFrame:
        rows: DataFrame = self.blocked[table]
        at: Column = (F.col(_BLOCK) == id // self.ids_per_block) & (F.col(f"{table[:-1]}_id") == id)
        return rows.where(at).drop(_BLOCK)

    def by_hash(self, hash: str) -> DataFrame:
        """The commit with a hash, from the row groups whose Bloom filters know it."""
        return self.tables["commits"].where(F.col("hash") == hash)
