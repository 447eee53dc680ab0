"""The history store: named tables, opened from Parquet or from any DataFrames."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Chains, chains, closure, expand, expand_to, reach
from .tables import Lazy

NAMES = ("projects", "project_metadata", "project_logs", "project_heads", "commits", "commit_parents", "commit_changes", "paths", "users", "snapshots")

#: The JSON fields of project metadata.
METADATA = (
    "fork BOOLEAN, archived BOOLEAN, disabled BOOLEAN, stargazers_count BIGINT, watchers_count BIGINT, size BIGINT, forks BIGINT, subscribers_count BIGINT, "
    "language STRING, description STRING, homepage STRING, license STRUCT<name: STRING>, has_issues BOOLEAN, has_downloads BOOLEAN, has_wiki BOOLEAN, has_pages BOOLEAN, "
    "created_at STRING, updated_at STRING, pushed_at STRING, default_branch STRING, issues_count BIGINT, buggy_issues_count BIGINT, open_issues_count BIGINT"
)


def _edges(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("commit_id").alias("a"), F.col("parent_id").alias("b"), "pos")


class History:
    """Tables of a version-control history. Nothing is read before it is used."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, substores: list[str] | None = None, as_of: int | None = None) -> History:
        """Tables at path/NAME.parquet; only what belongs to projects of these substores, and only what was there at a time."""
        found = cls({name: spark.read.parquet(f"{path}/{name}.parquet") for name in NAMES})
        if substores:
            found = found.of_substores(substores)
        return found if as_of is None else found.at(as_of)

    def of_substores(self, substores: list[str]) -> History:
        """The projects of these substores, with their metadata, logs and heads; so nothing reaches other projects' commits."""
        projects = self.projects.where(F.col("substore").isin(substores))
        mine = lambda name: lambda: self.tables[name].join(projects.select("project_id"), "project_id", "left_semi")
        found = History(ChainMap({"projects": projects}, Lazy({name: mine(name) for name in ("project_metadata", "project_logs", "project_heads")}), self.tables))
        if "chains" in self.__dict__:  # the commits are the same
            found.__dict__["chains"] = self.chains
        return found

    def at(self, time: int) -> History:
        """Commits up to a committer time, with their parents and changes, and logs up to it. A head on a later commit stands
        on the first kept commits that it leads to, so it may have several rows; one that leads to none is gone."""
        kept = lambda name: lambda: self.tables[name].join(found.commits.select("commit_id"), "commit_id", "left_semi")
        then = {"commits": lambda: self.commits.where(F.col("committer_time") <= time), "project_logs": lambda: self.project_logs.where(F.col("time") <= time)}
        found = History(ChainMap(Lazy(then | {name: kept(name) for name in ("commit_parents", "commit_changes")} | {"project_heads": lambda: self._heads_on(found.commits)}), self.tables))
        return found

    def _heads_on(self, commits: DataFrame) -> DataFrame:
        """The heads on these commits; for one on another commit, a head on each of the first of them that it leads to."""
        kept = commits.select("commit_id")
        parents, heads = self.commit_parents, self.project_heads
        late = closure(_edges(parents.join(kept, "commit_id", "left_anti")), heads.join(kept, "commit_id", "left_anti").select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node")))
        moved = late.join(kept, F.col("node") == F.col("commit_id"), "left_semi").select("seed", "node")
        moved = heads.join(moved, F.col("commit_id") == F.col("seed")).withColumn("commit_id", F.col("node"))
        if "hash" in heads.columns:
            moved = moved.drop("hash").join(commits.select("commit_id", "hash"), "commit_id")
        return heads.join(kept, "commit_id", "left_semi").select(*heads.columns).unionByName(moved.select(*heads.columns)).distinct()

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.tables[name]
        raise AttributeError(name)

    def by_id(self, table: str, id: int) -> DataFrame:
        """One project, commit, user, path or snapshot."""
        return self.tables[table].where(F.col(f"{table[:-1]}_id") == id)

    @cached_property
    def metadata(self) -> DataFrame:
        """The metadata fields as typed columns, times as epoch seconds; a field of the wrong type is missing."""
        m = F.from_json("json", METADATA)
        seconds = lambda c: F.unix_seconds(F.try_to_timestamp(F.col(f"m.{c}"))).alias(c.removesuffix("_at"))
        parsed = self.project_metadata.select("project_id", m.alias("m"))
        plain = [c.split()[0] for c in METADATA.split(", ") if not c.split()[0].endswith("_at") and not c.startswith("license")]
        return parsed.select("project_id", *[F.col(f"m.{c}") for c in plain], F.col("m.license.name").alias("license"), *map(seconds, ("created_at", "updated_at", "pushed_at")))

    @cached_property
    def project_commits(self) -> DataFrame:
        """(project_id, commit_id): all commits reachable from any head, each once, also those without a row in commits."""
        return expand(self.chains, self._reached).select(F.col("seed").alias("project_id"), F.col("node").alias("commit_id"))

    @cached_property
    def project_roots(self) -> DataFrame:
        """(project_id, root_id): those of project_commits that have no parent."""
        roots = expand_to(self.chains, self._reached, self.commit_parents.select(F.col("commit_id").alias("node")))
        return roots.select(F.col("seed").alias("project_id"), F.col("node").alias("root_id"))

    @cached_property
    def _reached(self) -> DataFrame:
        return reach(self.chains, self._seeds(self.project_heads))

    def main_branch_commits(self, branch: DataFrame) -> DataFrame:
        """As project_commits, from the head refs/heads/<branch> only. branch: (project_id, default_branch)."""
        return self._reachable(self.project_heads.join(branch, "project_id").where(F.col("name") == F.concat(F.lit("refs/heads/"), "default_branch")))

    @cached_property
    def chains(self) -> Chains:
        """The chains of the commit graph, found once for all that is asked of it."""
        return chains(_edges(self.commit_parents))

    def reachable(self, seeds: DataFrame) -> DataFrame:
        """(seed, node): the commits that the seeds (seed, node) reach, themselves included, each once."""
        return expand(self.chains, reach(self.chains, seeds))

    def _reachable(self, heads: DataFrame) -> DataFrame:
        return self.reachable(self._seeds(heads)).select(F.col("seed").alias("project_id"), F.col("node").alias("commit_id"))

    @staticmethod
    def _seeds(heads: DataFrame) -> DataFrame:
        return heads.select(F.col("project_id").alias("seed"), F.col("commit_id").alias("node")).distinct()

    @cached_property
    def full_commits(self) -> DataFrame:
        """project_commits with the commits' fields; ids without a commit drop out."""
        return self.project_commits.join(self.commits, "commit_id")

    @cached_property
    def full_changes(self) -> DataFrame:
        """(project_id, commit_id, path_id, snapshot_id)."""
        return self.project_commits.join(self.commit_changes, "commit_id")
