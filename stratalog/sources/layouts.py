"""Export layouts of the entities: one row each, with fixed columns; the extended ones add the slower figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import language_of_name, language_of_path
from ..functions.statistics import length
from ..operators import metrics
from .history import History
from .tables import materialized

# The columns of the layouts, in their order.
PROJECT = [
    "project_id",
    "substore",
    "url",
    "is_fork",
    "is_archived",
    "is_disabled",
    "stars",
    "watchers",
    "size",
    "open_issues",
    "buggy_issues",
    "all_issues",
    "issues",
    "forks",
    "subscribers",
    "language",
    "lifetime",
    "has_issues",
    "has_downloads",
    "has_wiki",
    "has_pages",
    "created",
    "updated",
    "pushed",
    "default_branch",
    "license",
    "homepage",
    "description",
    "heads",
    "commits",
    "authors",
    "committers",
    "users",
]
PROJECT_EXTENDED = [
    "paths",
    "snapshots",
    "unique_files",
    "original_files",
    "impact",
    "files",
    "major_language",
    "major_language_ratio",
    "major_language_changes",
    "all_forks_count",
    "max_commit_delta",
    "avg_commit_delta",
    "first_commit",
    "last_commit",
    "is_abandoned",
    "locs",
    "duplicated_code",
    "is_valid",
    "max_experience",
    "project_experience",
    "authors_contributing_95%_commits",
    "authors_contributing_80%_commits",
    "authors_contributing_50%_commits",
    "authors_contributing_95%_changes",
    "authors_contributing_80%_changes",
    "authors_contributing_50%_changes",
]
USER = [
    "user_id",
    "email",
    "authored_commits",
    "committed_commits",
    "author_experience",
    "committer_experience",
    "experience",
]
COMMIT = [
    "commit_id",
    "hash",
    "committer_id",
    "author_id",
    "parent_ids",
    "parent_count",
    "author_timestamp",
    "committer_timestamp",
    "changed_paths",
    "changed_path_count",
]
CHANGE = [
    "path_id",
    "snapshot_id",
]
METADATA_ROW = [
    "project_id",
    "is_fork",
    "is_archived",
    "is_disabled",
    "star_gazers",
    "watchers",
    "size",
    "open_issues",
    "forks",
    "subscribers",
    "license",
    "description",
    "homepage",
    "language",
    "has_issues",
    "has_downloads",
    "has_wiki",
    "has_pages",
    "created",
    "updated",
    "pushed",
    "master",
]
COMMIT_EXTENDED = [
    "message",
    "message_length",
]


def _with(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, rows)


def _size(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _in_steps(rows: DataFrame, key: str, *others: DataFrame, step: int = 6) -> DataFrame:
    """As _with. Each of the others is written before it is joined, and so are the rows after every few joins: so no task makes several
    figures, or sorts for many joins, at once."""
    for at in range(0, len(others), step):
        rows = materialized(_with(rows, key, *map(materialized, others[at : at + step])))
    return rows


def project_rows(h: History, extended: bool = False) -> DataFrame:
    renamed = {"fork": "is_fork", "archived": "is_archived", "disabled": "is_disabled", "stargazers_count": "stars", "watchers_count": "watchers", "open_issues_count": "open_issues", "buggy_issues_count": "buggy_issues", "issues_count": "issues", "subscribers_count": "subscribers"}
    m = h.metadata.withColumnsRenamed(renamed).withColumn("language", language_of_name(F.col("language")))
    some = F.col("issues").isNotNull() | F.col("buggy_issues").isNotNull()
    m = m.withColumn("all_issues", F.when(some, F.coalesce("issues", F.lit(0)) + F.coalesce("buggy_issues", F.lit(0))))
    counts = materialized(metrics.counts(h)) if extended else metrics.counts(h)
    plain = _with(h.projects.select("project_id", "substore", "url"), "project_id", m, metrics.ages(h).withColumnRenamed("age", "lifetime"), _size(h.project_heads, "project_id", "heads"), counts)
    if not extended:
        return plain.select(*PROJECT)
    # What several figures are taken from is made once.
    held, gaps = materialized(metrics.holdings(h)), materialized(metrics.commit_gaps(h))
    active = metrics.activity(h, gaps).withColumnsRenamed({"since_first": "first_commit", "since_last": "last_commit"})
    gaps = gaps.withColumnsRenamed({"max_gap": "max_commit_delta", "mean_gap": "avg_commit_delta"})
    experience = metrics.project_experience(h, counts).select("project_id", "max_experience", F.col("mean_experience").alias("project_experience"))
    major = metrics.major_language(h).withColumnsRenamed({"language": "major_language", "share": "major_language_ratio", "changes": "major_language_changes"})
    content = metrics.content_counts(h, held).withColumn("files", F.col("paths"))
    cutoffs = [metrics.main_contributor_counts(h, (95, 80, 50), of) for of in ("commits", "changes")]
    figures = _in_steps(
        h.projects.select("project_id").distinct(), "project_id", content, metrics.originality(h, held), major, metrics.fork_counts(h).where("forks > 0").withColumnRenamed("forks", "all_forks_count"), gaps, active, metrics.project_locs(h),
        metrics.update_state(h).select("project_id", "is_valid"), experience, *cutoffs,
    )
    return _with(plain, "project_id", figures).select(*PROJECT, *[F.col(f"`{c}`") for c in PROJECT_EXTENDED])


def user_rows(h: History) -> DataFrame:
    times = metrics.user_times(h).withColumnsRenamed({"authored": "authored_commits", "committed": "committed_commits"})
    return _with(h.users, "user_id", times).select(*USER)


def commit_rows(h: History, extended: bool = False) -> DataFrame:
    """Parent ids in their order and changed path ids ascending, as arrays (lists with spaces in a CSV)."""
    parents = h.commit_parents.groupBy("commit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent_id"))), lambda p: p["parent_id"]).alias("parent_ids"))
    paths = h.commit_changes.groupBy("commit_id").agg(F.array_sort(F.collect_list("path_id")).alias("changed_paths"))
    none = F.array().cast("array<bigint>")
    rows = _with(h.commits, "commit_id", parents, paths).withColumnsRenamed({"author_time": "author_timestamp", "committer_time": "committer_timestamp"})
    rows = rows.withColumn("parent_ids", F.coalesce("parent_ids", none)).withColumn("changed_paths", F.coalesce("changed_paths", none))
    rows = rows.withColumn("parent_count", F.size("parent_ids").cast("long")).withColumn("changed_path_count", F.size("changed_paths").cast("long"))
    return rows.withColumn("message_length", length(F.col("message"))).select(*COMMIT, *(COMMIT_EXTENDED if extended else []))


def path_rows(h: History) -> DataFrame:
    return h.paths.select("path_id", F.col("location").alias("path"), language_of_path(F.col("location")).alias("language"))


def snapshot_rows(h: History) -> DataFrame:
    """Contents as text; bytes that aren't UTF-8 become replacement characters."""
    return h.snapshots.select("snapshot_id", F.expr("make_valid_utf8(cast(contents AS string))").alias("content"))


def change_rows(h: History) -> DataFrame:
    return h.commit_changes.select(*CHANGE)


def metadata_rows(h: History) -> DataFrame:
    names = {"fork": "is_fork", "archived": "is_archived", "disabled": "is_disabled", "stargazers_count": "star_gazers", "watchers_count": "watchers", "open_issues_count": "open_issues", "subscribers_count": "subscribers", "default_branch": "master"}
    return h.metadata.withColumnsRenamed(names).withColumn("language", language_of_name(F.col("language"))).select(*METADATA_ROW)


def head_rows(h: History) -> DataFrame:
    return h.project_heads.join(h.commits.select("commit_id", "hash"), "commit_id", "left").select("name", "commit_id", "hash")


def tree_rows(h: History, commits: DataFrame, deletions: bool = False) -> DataFrame:
    """The files as of each of the commits (commit_id), with the commit's hash and the path's location and language."""
    hashes = commits.select("commit_id").distinct().join(h.commits.select(F.col("commit_id").alias("of"), F.col("hash").alias("commit_hash")), F.col("commit_id") == F.col("of"), "left")
    seeds = hashes.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node"), "commit_hash")  # hashes join the few commits, not the trees
    rows = metrics.trees_of(h, seeds, deletions).withColumnRenamed("seed", "commit_id")
    return _with(rows, "path_id", path_rows(h)).select("commit_id", "commit_hash", "path_id", "path", "language", "snapshot_id")
