"""Selection verbs over rows and groups: filter, sort, group, sample, project, ungroup.

A Selection is a DataFrame with an order (columns that break all ties) and, if grouped, key columns. A verb only edits
these; nothing runs until the DataFrame is used. Rows of a group stay rows that carry the key, so groups are as large as
they like; the keys found when rows are grouped are a frame beside them, so a group left without rows is still a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import Sampler


@dataclass(frozen=True)
class Selection:
    """order: (column name, ascending) pairs, the most significant first."""

    rows: DataFrame
    order: tuple[tuple[str, bool], ...]
    keys: tuple[str, ...] = ()
    groups: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, *ids: str) -> Selection:
        """Rows in ascending order of their ids."""
        return cls(rows, tuple((i, True) for i in ids))

    def filter_by(self, condition: Column) -> Selection:
        return replace(self, rows=self.rows.where(condition))

    def sort_by(self, value: Column, ascending: bool = False) -> Selection:
        """Stable. Descending (the default) reverses the ascending order as a whole, ties included; missing comes last then."""
        name = f"_sort_{len(self.rows.columns)}"
        kept = self.order if ascending else tuple((c, not up) for c, up in self.order)
        return replace(self, rows=self.rows.withColumn(name, value), order=((name, ascending), *kept))

    def group_by(self, **keys: Column) -> Selection:
        """Missing keys form a group of their own."""
        rows = self.rows
        for name, value in keys.items():
            rows = rows.withColumn(name, value)
        return replace(self, rows=rows, keys=tuple(keys), groups=rows.select(*keys).distinct())

    def per_group(self, **figures: Column) -> DataFrame:
        """The keys of all groups, also of those whose rows are all filtered out, with aggregates over their rows: for a group
        without rows, counts are 0 and other aggregates null."""
        if self.groups is None:
            raise ValueError("rows must be grouped")
        marked = self.rows.withColumn("_row", F.lit(True))
        keys = self.groups.select(*[F.col(k).alias(f"_key_{k}") for k in self.keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys])
        names = [F.col(f"_key_{k}").alias(k) for k in self.keys]
        rows = marked.groupBy(*self.keys).agg(*[value.alias(name) for name, value in figures.items()], F.count("_row").alias("_n"))
        # What the aggregates give over no rows at all; the optimizer knows it without a job.
        nothing = marked.limit(0).agg(*[value.alias(name) for name, value in figures.items()])
        none = nothing.first()
        given = {f: F.lit(none[f]).cast(nothing.schema[f].dataType) for f in figures}
        return keys.join(rows, same, "left").select(*names, *[F.when(F.col("_n").isNull(), given[f]).otherwise(F.col(f)).alias(f) for f in figures])

    def sample(self, sampler: Sampler) -> Selection:
        """What the sampler takes of all rows, or of each group, in the order."""
        return replace(self, rows=sampler.take(self.rows, list(self.keys), self.ordering()))

    def ungroup(self) -> Selection:
        return replace(self, keys=(), groups=None)

    def map_into(self, *columns: Column) -> DataFrame:
        """The columns (after the keys, if grouped)."""
        return self.rows.select(*self.keys, *columns)

    def ordering(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def ordered(self) -> DataFrame:
        """The rows, sorted over the whole cluster."""
        return self.rows.orderBy(*self.ordering()).drop(*[c for c in self.rows.columns if c.startswith("_sort_")])

    def numbered(self, name: str = "rank") -> DataFrame:
        """The rows of each group with their places in the order, from 1."""
        return self.rows.withColumn(name, F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.ordering())))


def side(rows: DataFrame, pairs: str, at: int) -> Column:
    """One side of pairs (0 or 1): of a struct, of each struct in a list, or the keys or values of a map."""
    kind = rows.schema[pairs].dataType
    if kind.typeName() == "map":
        return (F.map_keys, F.map_values)[at](pairs)
    if kind.typeName() == "array":
        return F.transform(pairs, lambda p: p[kind.elementType.names[at]])
    return F.col(pairs)[kind.names[at]]


def dropped(rows: DataFrame, tuples: str, at: int) -> Column:
    """A struct, or each struct in a list, without its field at a place."""
    kind = rows.schema[tuples].dataType
    if kind.typeName() == "array":
        return F.transform(tuples, lambda t: t.dropFields(kind.elementType.names[at]))
    return F.col(tuples).dropFields(kind.names[at])


def products(rows: DataFrame, *collections: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each combination of the array columns' elements, the last varying fastest in page order.

    An empty array gives no row; a missing one gives one row with a null.
    """
    for c in collections:
        rows = rows.withColumn(c, F.explode(F.coalesce(F.col(c), F.array(F.lit(None)))))
    return rows.select(*keep, *collections)


def classify(value: Column, thresholds: list[tuple[str, float]], default: str, inclusive: bool = True) -> Column:
    """The name of the first threshold, in the list's order, that the value reaches; NA for a missing value."""
    names = [n for n, _ in thresholds]
    if len(set(names)) < len(names):
        raise ValueError("threshold names must differ")
    column = F.when(value.isNull(), F.lit("NA"))
    for name, t in thresholds:
        column = column.when(value >= t if inclusive else value > t, F.lit(name))
    return column.otherwise(F.lit(default))


def classify_by(name: Callable[[Column], Column], value: Column) -> Column:
    """The name that a function gives the value; NA where it gives none."""
    return F.coalesce(name(value), F.lit("NA"))
