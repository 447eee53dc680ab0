"""Running figures over ordered groups of any size.

Rows are sorted over the whole cluster and dealt into blocks, so that a large group takes many blocks and a small one is part
of one. Windows see one block of a group at a time; what the blocks before hold is joined to them, one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized

_PAST = (Window.unboundedPreceding, Window.currentRow)


def _in_blocks(dealt: DataFrame) -> DataFrame:
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return materialized(dealt).select("*", part.alias("_block"))


class Blocks:
    """df in blocks by group and order. Columns that begin with an underscore are its own.

    keep: the columns (group among them) that are kept, if the order needs others; rows then have their order in _row.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str | Column], keep: list[str] | None = None, blocks: int | None = None):
        self.group, self.order = group, order
        by = [*group, *order]
        dealt = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
        if keep:
            dealt, self.order = dealt.sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("_row")), ["_row"]
        self.rows = _in_blocks(dealt)

    @classmethod
    def sorted(cls, df: DataFrame, group: list[str]) -> Blocks:
        """df whose partitions are in the order of group and _row already, one after the other: these are the blocks."""
        found = cls.__new__(cls)
        found.group, found.order, found.rows = group, ["_row"], _in_blocks(df)
        return found

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.group, "_block").orderBy(*self.order)

    def _with_earlier(self, rows: DataFrame, figure: Column, combine, name: str) -> DataFrame:
        """rows with what `combine` makes of the earlier blocks' figures of the same group.

        As blocks follow each other, only the first and the last group of a block can be in others too. There are at most two of
        them for each block; so their figures go to the rows, which stay where they are.
        """
        of = {c: F.col(f"_of_{c}") for c in self.group}
        same = F.lit(True)
        for c in self.group:
            same &= F.col(c).eqNullSafe(of[c])
        group = F.struct(*[F.col(c).alias(f"_of_{c}") for c in self.group])
        ends = self.rows.groupBy("_block").agg(F.array(F.min(group), F.max(group)).alias("_ends")).select(F.inline("_ends")).distinct()
        each = self.rows.join(F.broadcast(ends), same, "left_semi").groupBy(*self.group, "_block").agg(figure.alias("_figure"))
        before = combine(Window.partitionBy(*self.group).orderBy("_block"))
        edges = each.select(*[F.col(c).alias(f"_of_{c}") for c in self.group], F.col("_block").alias("_of_block"), before.alias(name)).where(F.col(name).isNotNull())
        return rows.join(F.broadcast(edges), same & (F.col("_block") == F.col("_of_block")), "left").drop("_of_block", *[f"_of_{c}" for c in self.group])

    def running(self, name: str, value: Column, kind: str = "sum", frame: str = "rows") -> DataFrame:
        """rows with `name`: the sum or the maximum of value up to this row of its group. frame="range": with all its peers."""
        return self.runnings({name: value}, kind, frame)

    def runnings(self, values: dict[str, Column], kind: str = "sum", frame: str = "rows", wholes: dict[str, Column] | None = None) -> DataFrame:
        """As running, for several values. wholes: values of which each row gets the sum or the maximum over its whole group."""
        wholes = wholes or {}
        f = {"sum": F.sum, "max": F.max}[kind]
        over = self.window.rowsBetween(*_PAST) if frame == "rows" else self.window.rangeBetween(*_PAST)
        everywhere = (Window.unboundedPreceding, Window.unboundedFollowing)
        figures = F.struct(*[f(value).alias(name) for name, value in (values | wholes).items()])
        frames = dict.fromkeys(values, (Window.unboundedPreceding, -1)) | dict.fromkeys(wholes, everywhere)
        before = lambda w: F.struct(*[f(F.col("_figure")[name]).over(w.rowsBetween(*rows)).alias(name) for name, rows in frames.items()])
        inside = {name: f(value).over(over) for name, value in values.items()} | {name: f(value).over(self.window.rowsBetween(*everywhere)) for name, value in wholes.items()}
        rows = self._with_earlier(self.rows.withColumns(inside), figures, before, "_before")
        earlier = lambda name: F.col("_before")[name]
        whole = {name: F.coalesce(F.col(name) + earlier(name), name, earlier(name)) if kind == "sum" else F.greatest(name, earlier(name)) for name in values}
        whole |= {name: F.coalesce(earlier(name), name) for name in wholes}
        return rows.withColumns(whole).drop("_before", "_block")

    def previous(self, name: str, value: Column) -> DataFrame:
        """rows with `name`: value in the row before in its group, null in the first."""
        packed = F.struct(value.alias("v"))
        rows = self.rows.withColumn("_lag", F.lag(packed).over(self.window))
        last = F.max_by(packed, F.struct(*[c if isinstance(c, Column) else F.col(c) for c in self.order]))
        rows = self._with_earlier(rows, last, lambda w: F.lag("_figure").over(w), "_before")
        return rows.withColumn(name, F.coalesce("_lag", "_before")["v"]).drop("_lag", "_before", "_block")


def order_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, low, high): how many values each group has, and its middle value or two middle ones, exactly.

    Equal values are counted before they meet, and the counts are summed in the order of the values; no group is gathered.
    Null values don't count; a group of nothing else has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    summed = Blocks(counts, group, ["_v"]).running("_up_to", F.col("_c"))
    whole = summed.groupBy(*group).agg(F.max("_up_to").alias("n")).select(*[F.col(c).alias(f"_of_{c}") for c in group], "n")
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    at = lambda rank: F.max(F.when((F.col("_up_to") - F.col("_c") < rank) & (F.col("_up_to") >= rank), F.col("_v")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return summed.join(whole, same).groupBy(*group).agg(F.first("n").alias("n"), at(low).alias("low"), at(high).alias("high"))


def join_frequent(rows: DataFrame, facts: DataFrame, key: str, often: str, most: int = 100_000) -> DataFrame:
    """rows joined to facts, which have one row for each key and, as `often`, how many of rows have it at most.

    Keys that more than one in `most` of all rows have are at most that many: their facts are broadcast, so their rows stay where they
    are. All others are joined over their keys.
    """
    total = facts.agg(F.sum(often)).first()[0] or 0
    frequent = F.col(often) > max(10_000, total // most)
    hot = facts.where(frequent).withColumnRenamed(key, "_hot")
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot")).drop("_hot")
    rest = rows.join(F.broadcast(hot.select("_hot")), F.col(key) == F.col("_hot"), "left_anti").join(facts.where(~frequent), key)
    return found.select(*rest.columns).unionByName(rest)
