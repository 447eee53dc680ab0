"""Collections of entities as tables of (owner, id), each pair once, and the entities behind ids.

An id whose entity is not in the store stays in a table of ids and drops out of a table of entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.history import History
from ..sources.tables import distinct_of, materialized
from .graph import reach


def _pairs(rows: DataFrame, owner: str, id: str, name: str) -> DataFrame:
    return rows.where(F.col(owner).isNotNull() & F.col(id).isNotNull()).select(owner, F.col(id).alias(name)).distinct()


# Of projects


def project_people(h: History, role: str) -> DataFrame:
    """(project_id, user_id). role: author, committer, or user for either."""
    roles = ("author", "committer") if role == "user" else (role,)
    people = h.full_commits.select("project_id", F.explode(F.array(*[f"{r}_id" for r in roles])).alias("user_id"))
    return _pairs(people, "project_id", "user_id", "user_id")


def project_paths(h: History) -> DataFrame:
    """(project_id, path_id) of all changes, deletions too."""
    return distinct_of(h.full_changes.where("project_id IS NOT NULL AND path_id IS NOT NULL").select("project_id", "path_id"), h.commit_changes)


def project_snapshots(h: History) -> DataFrame:
    """(project_id, snapshot_id) of all changes, with and without stored contents."""
    return distinct_of(h.full_changes.where("project_id IS NOT NULL AND snapshot_id IS NOT NULL").select("project_id", "snapshot_id"), h.commit_changes)


def tree_snapshots(tree: DataFrame, owner: str) -> DataFrame:
    """(owner, snapshot_id): the different snapshots in a tree of (owner, path_id, snapshot_id), deletions aside."""
    return _pairs(tree, owner, "snapshot_id", "snapshot_id")


# Of users, heads and commits


def user_commits(h: History, role: str) -> DataFrame:
    """(user_id, commit_id). role: author or committer."""
    return _pairs(h.commits.withColumnRenamed(f"{role}_id", "user_id"), "user_id", "commit_id", "commit_id")


def preceding_commits(h: History, commits: DataFrame) -> DataFrame:
    """(of, commit_id): the ancestors of commits (commit_id), each with itself."""
    return h.reachable(commits.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node"))).select(F.col("seed").alias("of"), F.col("node").alias("commit_id"))


def preceding_counts(h: History, commits: DataFrame) -> DataFrame:
    """(of, preceding): how many ancestors commits (commit_id) have, with themselves. No ancestor is listed for it."""
    reached = reach(h.chains, commits.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node")))
    ends = h.chains.nodes.groupBy(F.col("chain").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    joined = reached.join(ends, F.col("chain") == F.col("c"), "left")
    return joined.groupBy(F.col("seed").alias("of")).agg(F.sum(F.coalesce(F.col("n") - F.col("start"), F.lit(1))).alias("preceding"))


def head_commits(h: History) -> DataFrame:
    """(project_id, name, commit_id): the commits that each head reaches."""
    heads = h.project_heads.select("project_id", "name", F.col("commit_id").alias("head"))
    return heads.join(preceding_commits(h, h.project_heads), F.col("head") == F.col("of")).select("project_id", "name", "commit_id")


def commit_parents(h: History) -> DataFrame:
    """(commit_id, pos) with the parents' fields, prefixed by parent_."""
    parents = h.commits.select(*[F.col(c).alias(f"parent_{c}") for c in h.commits.columns])
    return h.commit_parents.join(parents, F.col("parent_id") == F.col("parent_commit_id")).drop("parent_commit_id")


def with_contents(h: History, rows: DataFrame) -> DataFrame:
    """rows (snapshot_id, ...) with has_contents: whether the snapshot's contents are stored; missing for a deletion."""
    stored = h.snapshots.where(F.col("contents").isNotNull()).select(F.col("snapshot_id").alias("_stored")).distinct()
    return rows.join(stored, F.col("snapshot_id") == F.col("_stored"), "left").withColumn("has_contents", F.when(F.col("snapshot_id").isNotNull(), F.col("_stored").isNotNull())).drop("_stored")


# Behind ids


def paths_of(h: History, rows: DataFrame) -> DataFrame:
    """rows, for each path_id with its location."""
    return rows.join(h.paths, "path_id")


def snapshots_of(h: History, rows: DataFrame, **figures: Column) -> DataFrame:
    """rows, for each snapshot_id with its contents, or only with figures of them, taken once for each snapshot before the join."""
    snapshots = h.snapshots.select("snapshot_id", *[c.alias(name) for name, c in figures.items()]) if figures else h.snapshots
    if figures:  # of every snapshot once, not of every row that has it
        snapshots = materialized(snapshots)
    return rows.join(snapshots, "snapshot_id")


def users_of(h: History, rows: DataFrame) -> DataFrame:
    """rows, for each user_id with the address."""
    return rows.join(h.users, "user_id")


def commits_of(h: History, rows: DataFrame) -> DataFrame:
    """rows, for each commit_id with the commit's fields."""
    return rows.join(h.commits, "commit_id")
