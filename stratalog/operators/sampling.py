"""Samplers. Each takes rows, group keys and an order, and returns the rows it keeps of all rows or of each group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized
from .blocks import Blocks


class Sampler:
    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        raise NotImplementedError


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each group: a group limit before the shuffle bounds what a group sends. Without keys, a top-n."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class Top(Sampler):
    n: int

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        return _first(rows, keys, order, self.n)


@dataclass(frozen=True)
class Random(Sampler):
    """n rows drawn without replacement: the first by the MD5 of seed and id, which any engine can repeat."""

    n: int
    seed: int
    id: str

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        return _first(rows, keys, [seeded(self.seed, F.col(self.id)), F.col(self.id)], self.n)


def seeded(seed: int, id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id.cast("string")))


@dataclass(frozen=True)
class Distinct(Sampler):
    """Of rows with an equal attribute (missing equals missing) only the first, then the inner sampler."""

    inner: Sampler
    by: str

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        return self.inner.take(_first(rows, [*keys, self.by], order, 1), keys, order)


@dataclass(frozen=True)
class DistinctRandom(Sampler):
    """n rows drawn in the order of Random; of rows with an equal attribute, or similar by a MinRatio, only the first drawn."""

    n: int
    seed: int
    id: str
    by: str | MinRatio

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        drawn = [seeded(self.seed, F.col(self.id)), F.col(self.id)]
        if isinstance(self.by, MinRatio):
            return replace(self.by, n=self.n, of="kept", inner=None).take(rows, keys, drawn)
        return _first(_first(rows, [*keys, self.by], drawn, 1), keys, drawn, self.n)


@dataclass(frozen=True)
class MinRatio(Sampler):
    """The first n rows, greedily, that are not similar to a row kept before. inner: taken of all such rows instead, n aside.

    Two rows are similar when more than `ratio` of one's distinct elements are the other's too: the candidate's share, or
    the kept row's with of="kept". Missing is similar to missing only; an empty set is similar to nothing. The rows' ids
    differ.

    Of rows with equal sets only the first is looked at. Rows are decided from the top, in stretches of which each is twice as
    long as the one before, until the groups have n rows: those similar to a row kept from an earlier stretch drop out, then
    those without an earlier similar row are kept and what is similar to them drops out, in rounds. Similar rows
    are found by a join of one's rarest elements, as many as it takes to be sure of a common one, with all of the other's.
    """

    n: int
    elements: str
    ratio: float
    id: str
    of: str = "candidate"
    inner: Sampler | None = None
    block: int = 512

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        firsts = self._placed(rows, keys, order)
        last = firsts.agg(F.max("k")).first()[0]
        chosen, low, size = None, 0, self.block
        while last is not None and low <= last:
            part = firsts.where((F.col("k") >= low) & (F.col("k") < low + size))
            rest = firsts.where(F.col("k") >= low + size).select("g").distinct()
            if chosen is not None:
                if self.inner is None:
                    full = chosen.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.n)
                    part, rest = part.join(full, "g", "left_anti"), rest.join(full, "g", "left_anti")
                part = materialized(part.join(self._similar(part, chosen).select("g", "k").distinct(), ["g", "k"], "left_anti"))
            kept = self._first_of_similar(part)
            chosen = kept if chosen is None else materialized(chosen.unionByName(kept))
            low, size = low + size, 2 * size
            if self.inner is None and rest.join(chosen.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.n), "g", "left_anti").isEmpty():
                break
        if chosen is None:
            return rows.limit(0)
        if self.inner is None:
            chosen = _first(chosen, ["g"], [F.col("k")], self.n)
        out = rows.join(chosen.select(F.col("id").alias("_kept")), F.col(self.id) == F.col("_kept"), "left_semi")
        return out if self.inner is None else self.inner.take(out, keys, order)

    def _placed(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        """(g, k, id, e): group, place in it, id and sorted set of the first row with each set; of empty ones all rows."""
        group = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
        plain = rows.withColumns({"_g": group, "_e": F.array_sort(F.array_distinct(self.elements)), "_id": F.col(self.id)})
        placed = Blocks(plain, ["_g"], order, keep=["_g", "_e", "_id"]).running("k", F.lit(1))
        placed = placed.select(F.col("_g").alias("g"), F.col("_e").alias("e"), F.col("_id").alias("id"), (F.col("k") - 1).alias("k"))
        alone = F.when((F.size("e") == 0) | (F.col("e").isNotNull() & F.lit(self.ratio >= 1)), F.col("k"))
        firsts = placed.groupBy("g", "e", alone.alias("alone")).agg(F.min(F.struct("k", "id")).alias("first"))
        return materialized(firsts.select("g", "first.k", "first.id", "e"))

    def _similar(self, later: DataFrame, earlier: DataFrame) -> DataFrame:
        """(g, k, k2): rows of `later` similar to a row of `earlier` with a smaller place."""
        sets = [side.where(F.size("e") > 0).select("g", "k", F.size("e").alias("n"), F.explode("e").alias("x")) for side in (later, earlier)]
        common = sets[0].select("x").unionByName(sets[1].select("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        rarest = Window.partitionBy("g", "k").orderBy("c", "x")
        ranked = [side.join(common, "x").withColumn("p", F.row_number().over(rarest)) for side in sets]
        mine, other = ranked[0], ranked[1].select(*[F.col(c).alias(f"{c}2") for c in ("g", "k", "n", "x", "p")])
        whose, others = ("", "2") if self.of == "candidate" else ("2", "")
        # An overlap of `least` elements leaves least - 1 behind the first common one, in both sets.
        least = F.greatest(F.lit(1), F.floor(F.lit(self.ratio) * F.col(f"n{whose}")))
        sure = (F.col(f"n{whose}") - F.col(f"p{whose}") + 1 >= least) & (F.col(f"n{others}") - F.col(f"p{others}") + 1 >= least)
        pairs = mine.join(other, (F.col("x") == F.col("x2")) & (F.col("g") == F.col("g2")) & (F.col("k") > F.col("k2")) & sure).select("g", "k", "k2").distinct()
        first = later.select("g", "k", F.col("e").alias("a"))
        second = earlier.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("e").alias("b"))
        both = pairs.join(first, ["g", "k"]).join(second.withColumnRenamed("g2", "g"), ["g", "k2"])
        share = F.size(F.array_intersect("a", "b")) / F.size("a" if self.of == "candidate" else "b")
        return both.where(share > self.ratio).select("g", "k", "k2")

    def _first_of_similar(self, part: DataFrame) -> DataFrame:
        """The rows of a stretch that a greedy walk keeps."""
        edges = materialized(self._similar(part, part))
        left = edges.select("g", "k").distinct()
        kept = new = part.join(left, ["g", "k"], "left_anti")
        while not left.isEmpty():
            new = new.select("g", F.col("k").alias("k2"))
            left = materialized(left.join(edges.join(new, ["g", "k2"], "left_semi").select("g", "k").distinct(), ["g", "k"], "left_anti"))
            edges = materialized(edges.join(left, ["g", "k"], "left_semi").join(left.withColumnRenamed("k", "k2"), ["g", "k2"], "left_semi"))
            new = materialized(part.join(left.join(edges, ["g", "k"], "left_anti"), ["g", "k"], "left_semi"))
            kept = kept.unionByName(new)
            left = left.join(new, ["g", "k"], "left_anti")
        return materialized(kept)


@dataclass(frozen=True)
class Stratified(Sampler):
    """Each stratum by its own sampler; strata without one are dropped. stratum: a column of names."""

    stratum: str
    samplers: dict[str, Sampler]

    def take(self, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        parts: Iterator[DataFrame] = (s.take(rows.where(F.col(self.stratum) == name), keys, order) for name, s in self.samplers.items())
        out = next(parts)
        for part in parts:
            out = out.unionByName(part)
        return out
