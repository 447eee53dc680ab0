"""Reachability in commit graphs by chains, and file trees.

Each commit follows its first parent; of the commits that follow the same one, the one that leads from the farthest tip makes a chain
with it, the others end theirs. So a history is cut into chains from a tip towards the root, with places that rise on the
way. Whoever reaches a place of a chain reaches all places after it: what a commit reaches is one place for each chain, and
only edges between chains are ever followed. Chains are found by doubling, in as many rounds as the depth has bits;
reachability takes as many rounds as there are changes of chain on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucketed, materialized, shared_path
from .blocks import Blocks

_REACH = "seed long, chain long, start long, was long"


class Chains(NamedTuple):
    """nodes: (node, chain, place), chain being its tip; cross: (chain, place, to_chain, to_place) of all edges but those along a chain."""

    nodes: DataFrame
    cross: DataFrame

    def locate(self, rows: DataFrame, node: str) -> DataFrame:
        """rows with chain and place of a node; one without any edge is a chain of its own."""
        nodes = self.nodes.withColumnRenamed("node", "_node")
        return rows.join(nodes, F.col(node) == F.col("_node"), "left").withColumns({"chain": F.coalesce("chain", F.col(node)), "place": F.coalesce("place", F.lit(0).cast("long"))}).drop("_node")

    def named(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (chain, place, ...) with the node that is there."""
        nodes = self.nodes.select(F.col("node").alias("_node"), F.col("chain").alias("_chain"), F.col("place").alias("_place"))
        there = (F.col("chain") == F.col("_chain")) & (F.col("place") == F.col("_place"))
        return rows.join(nodes, there, "left").withColumn(name, F.coalesce("_node", "chain")).drop("_node", "_chain", "_place")


def chains(edges: DataFrame) -> Chains:
    """The chains of edges (a, b), or (a, b, pos) where a's parents have an order. Commits from which a cycle is reached by first
    parents are chains of one."""
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    rank = F.struct("pos", "b") if "pos" in edges.columns else F.col("b")
    first = edges.groupBy("a").agg(F.min_by("b", rank).alias("up"))
    every = edges.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("node")).distinct()
    state = bucketed(every.join(first, F.col("node") == F.col("a"), "left").select("node", F.col("up").cast("long").alias("up"), F.struct(F.lit(0).cast("long").alias("place"), F.col("node").alias("chain")).alias("best")), "node")
    hop, n = 1, None
    while not (going := state.where("up IS NOT NULL")).isEmpty():
        n = state.count() if n is None else n
        if hop > 2 * n:
            break
        # The state stays where it is: what moves are pairs to and from the node above, and one row for each that others lead to.
        below = going.groupBy(F.col("up").alias("of")).agg(F.max(F.struct((F.col("best.place") + hop).alias("place"), F.col("best.chain").alias("chain"))).alias("far"))
        above = going.select(F.col("node").alias("mid"), F.col("up").alias("next"))
        on = going.select(F.col("node").alias("from"), "up").join(above, F.col("up") == F.col("mid")).select("from", "next")
        joined = state.join(below, F.col("node") == F.col("of"), "left").join(on, F.col("node") == F.col("from"), "left")
        state = bucketed(joined.select("node", F.col("next").alias("up"), F.greatest("best", "far").alias("best")), "node")
        hop *= 2
    alone = F.col("up").isNotNull()  # leads into a cycle
    nodes = bucketed(state.select("node", F.when(alone, F.col("node")).otherwise(F.col("best.chain")).alias("chain"), F.when(alone, 0).otherwise(F.col("best.place")).cast("long").alias("place")), "node")
    at = lambda x, chain, place: nodes.select(F.col("node").alias(x), F.col("chain").alias(chain), F.col("place").alias(place))
    placed = edges.join(at("a", "chain", "place"), "a").join(at("b", "to_chain", "to_place"), "b")
    cross = placed.where("chain <> to_chain OR to_place <= place").groupBy("chain", "place", "to_chain").agg(F.min("to_place").alias("to_place"))
    return Chains(nodes, materialized(cross))


def reach(graph: Chains, seeds: DataFrame) -> DataFrame:
    """(seed, chain, start): the first place of each chain that the seeds (seed, node) reach."""
    spark, path = seeds.sparkSession, shared_path(seeds.sparkSession)
    begin = graph.locate(seeds.where("node IS NOT NULL").selectExpr("cast(seed as long) as seed", "cast(node as long) as node"), "node")
    front = materialized(begin.groupBy("seed", "chain").agg(F.min("place").alias("start")).withColumn("was", F.lit(None).cast("long")))
    front.write.parquet(path)
    cross = graph.cross.withColumnRenamed("chain", "from_chain")
    while True:
        found = spark.read.schema(_REACH).parquet(path).groupBy("seed", "chain").agg(F.min("start").alias("start"))
        if front.isEmpty():
            return found
        # A start that has moved only follows the edges between its new place and the old one.
        ahead = front.join(cross, (F.col("chain") == F.col("from_chain")) & (F.col("place") >= F.col("start")) & (F.col("was").isNull() | (F.col("place") < F.col("was"))))
        ahead = ahead.groupBy("seed", F.col("to_chain").alias("chain")).agg(F.min("to_place").alias("start"))
        known = found.select(F.col("seed").alias("s"), F.col("chain").alias("c"), F.col("start").alias("was"))
        moved = ahead.join(known, (F.col("seed") == F.col("s")) & (F.col("chain") == F.col("c")), "left").where("was IS NULL OR start < was")
        front = materialized(moved.select("seed", "chain", "start", "was"))
        front.write.mode("append").parquet(path)


def expand(graph: Chains, reached: DataFrame) -> DataFrame:
    """(seed, node): all nodes of what reach() gives."""
    nodes = graph.nodes.withColumnRenamed("chain", "of")
    joined = reached.join(nodes, F.col("chain") == F.col("of"), "left").where("of IS NULL OR place >= start")
    return joined.select("seed", F.coalesce("node", "chain").alias("node"))


def expand_to(graph: Chains, reached: DataFrame, left_out: DataFrame) -> DataFrame:
    """As expand, without the nodes left_out (node). No other nodes are listed on the way."""
    out = left_out.select(F.col("node").alias("_out"))
    ends = graph.nodes.join(out, F.col("node") == F.col("_out"), "left_anti").select("node", F.col("chain").alias("of"), "place")
    placed = reached.join(ends, (F.col("chain") == F.col("of")) & (F.col("place") >= F.col("start"))).select("seed", "node")
    tips = graph.nodes.where("node = chain").select(F.col("chain").alias("of"))
    single = reached.join(tips, F.col("chain") == F.col("of"), "left_anti").select("seed", F.col("chain").alias("node"))
    return placed.unionByName(single.join(out, F.col("node") == F.col("_out"), "left_anti"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): every node reachable along edges (a, b) from the seeds (seed, node), each once, with the seeds' own."""
    graph = chains(edges)
    return expand(graph, reach(graph, seeds))


def latest_times(graph: Chains, times: DataFrame, points: DataFrame) -> DataFrame:
    """points (chain, place) with `latest`, the latest of the times (node, time) of what they reach, themselves included."""
    placed = graph.locate(times.where("time IS NOT NULL"), "node").select("chain", "place", "time")
    values = placed.select("chain", "place", F.col("time").alias("value"), F.lit(None).cast("struct<chain: long, place: long>").alias("point"))
    targets = graph.cross.select(F.col("to_chain").alias("chain"), F.col("to_place").alias("place")).distinct()
    wanted = points.select("chain", "place").distinct()

    def lookup(values: DataFrame, at: DataFrame) -> DataFrame:
        """The greatest value at each place or after it on its chain."""
        asked = at.select("chain", "place", F.lit(None).cast("long").alias("value"), F.struct("chain", "place").alias("point"))
        rows = Blocks(values.unionByName(asked), ["chain"], [F.desc("place")]).running("latest", F.col("value"), "max", "range")
        return rows.where("point IS NOT NULL").select("point", "latest")

    # What edges between chains bring: first the times on their target's own chain, then what that chain's own edges bring.
    own = materialized(lookup(values, targets.unionByName(wanted).distinct()))
    to = F.struct(F.col("to_chain").alias("chain"), F.col("to_place").alias("place"))
    brought = own
    while True:
        carried = graph.cross.join(brought.withColumnRenamed("point", "p"), to == F.col("p")).select("chain", "place", F.col("latest").alias("value"), F.lit(None).cast("struct<chain: long, place: long>").alias("point"))
        more = lookup(carried, own.select("point.chain", "point.place")).withColumnRenamed("latest", "more").withColumnRenamed("point", "q")
        grown = materialized(own.join(more, F.col("point") == F.col("q")).select("point", F.greatest("latest", "more").alias("latest")))
        changed = grown.join(brought.select(F.col("point").alias("p"), F.col("latest").alias("had")), F.col("point") == F.col("p")).where("NOT latest <=> had")
        if changed.isEmpty():
            return points.join(grown.withColumnRenamed("point", "p"), F.struct("chain", "place") == F.col("p"), "left").drop("p")
        brought = grown


def trees(graph: Chains, seeds: DataFrame, changes: DataFrame, times: DataFrame | Callable[[], DataFrame] | None = None, deletions: bool = False) -> DataFrame:
    """(seed, path_id, snapshot_id): the state of each path as of the seeds (seed, node). Further columns of seeds are given to each
    row of their trees.

    changes: (commit_id, path_id, snapshot_id). The last change of a path wins: one that no other change of the path descends
    from. Of several such, on branches of which neither knows the other's, the one whose history is the latest by times (node,
    time), then the one with the greatest commit id. Deleted paths (null) are kept only with `deletions`.

    On one chain, a change holds for all who enter between the change before and itself. Those stretches are looked up by
    cells as large as they are: each lies in the cell of its first place, and who enters looks there and in the two cells before. So the
    rows joined are the changes and the files of the trees, not heads times changes. A seed that reaches one chain only has one
    stretch for each path; what others hold on several chains is gathered.
    """
    made = graph.locate(changes.where("path_id IS NOT NULL"), "commit_id").repartition("chain", "path_id").groupBy("chain", "path_id", "place").agg(F.min(F.struct("snapshot_id")).alias("s"))
    after = F.coalesce(F.lag("place").over(Window.partitionBy("chain", "path_id").orderBy("place")), F.lit(-1).cast("long"))
    stretches = made.select("chain", "path_id", after.alias("after"), "place", "s.snapshot_id").withColumn("level", F.length(F.bin(F.col("place") - F.col("after"))) - 1)
    stretches = stretches.withColumn("cell", F.expr("shiftright(after + 1, level)"))
    longest = graph.nodes.groupBy(F.col("chain").alias("c")).agg((F.length(F.bin(F.max("place") + 1)) - 1).alias("top"))
    reached = materialized(reach(graph, seeds.select("seed", "node")))
    reached = reached.join(reached.groupBy(F.col("seed").alias("s")).agg(F.count(F.lit(1)).alias("chains")), F.col("seed") == F.col("s")).drop("s")

    def held(entries: DataFrame) -> DataFrame:
        """entries (chain, start, ...), for each path with the stretch of the chain that holds there."""
        every = entries.join(longest, F.col("chain") == F.col("c"), "left").withColumn("level", F.explode(F.expr("sequence(0, coalesce(top, 0))"))).drop("c", "top")
        asked = every.withColumn("cell", F.explode(F.expr("sequence(greatest(shiftright(start, level) - least(level, 2), 0), shiftright(start, level))")))
        return asked.join(stretches, ["chain", "level", "cell"]).where("after < start AND start <= place")

    columns = ["seed", *[c for c in seeds.columns if c not in ("seed", "node")]]
    labels = seeds.select(*columns) if columns[1:] else None
    labelled = lambda rows: rows if labels is None else rows.join(labels, "seed")
    tree = held(labelled(reached.where("chains = 1"))).select(*columns, "path_id", "snapshot_id")
    several = reached.where("chains > 1").drop("chains")
    if not several.isEmpty():
        gathered = _of_several(graph, materialized(held(several).select("seed", "path_id", "chain", "place", "snapshot_id")), times)
        tree = tree.unionByName(labelled(gathered).select(*tree.columns))
    return tree if deletions else tree.where(F.col("snapshot_id").isNotNull())


def _of_several(graph: Chains, held: DataFrame, times: DataFrame | Callable[[], DataFrame] | None) -> DataFrame:
    """(seed, path_id, snapshot_id) of the stretches that seeds hold on all their chains."""
    whole = held.groupBy("seed", "path_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("snapshot_id")).alias("s"))
    tree = whole.where("n = 1").select("seed", "path_id", "s.snapshot_id")
    several = whole.where("n > 1").select("seed", "path_id")
    if several.isEmpty():
        return tree
    return tree.unionByName(_last_of_several(graph, materialized(graph.named(held.join(several, ["seed", "path_id"]), "commit_id")), times() if callable(times) else times))


def _last_of_several(graph: Chains, held: DataFrame, times: DataFrame | None) -> DataFrame:
    """Of each (seed, path_id) the last change among those on several chains."""
    lowest = F.lit(-(1 << 63)).cast("long")
    dated = held.withColumn("latest", lowest) if times is None else latest_times(graph, times, held).withColumn("latest", F.coalesce("latest", lowest))
    dated = materialized(dated)
    top = dated.groupBy("seed", "path_id").agg(F.max("latest").alias("latest"))
    tied = materialized(dated.join(top, ["seed", "path_id", "latest"]))
    among = tied.join(tied.groupBy("seed", "path_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["seed", "path_id"])
    # Whatever another tied change of the path reaches at or after the place of this one, this one comes before.
    reached = reach(graph, among.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node")).distinct()).select(F.col("seed").alias("by"), F.col("chain").alias("to"), "start")
    before = among.join(reached, (F.col("commit_id") == F.col("by")) & (F.col("chain") != F.col("to"))).groupBy("seed", "path_id", F.col("to").alias("chain")).agg(F.min("start").alias("start"))
    last = tied.join(before, ["seed", "path_id", "chain"], "left").where("start IS NULL OR start > place")
    return last.groupBy("seed", "path_id").agg(F.max_by(F.struct("snapshot_id"), "commit_id").alias("s")).select("seed", "path_id", "s.snapshot_id")
