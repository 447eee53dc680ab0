"""Metrics of projects, users, commits and snapshots: each takes a History and returns one row for each entity (or pair).

Collections are child tables with a foreign key; an entity without any has no row, or the value stated. compat=True gives
the variants whose counts differ from the intended definitions, as some published results used them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import language_of_path, ordinal
from ..functions.statistics import lines_of_code
from ..sources.history import History
from ..sources.tables import dealt_by, distinct_of, materialized
from .blocks import Blocks, join_frequent
from .graph import trees


def _span(low: list[str], high: list[str] | None = None) -> Column:
    high = high or low
    least = F.least(*low) if len(low) > 1 else F.col(low[0])
    greatest = F.greatest(*high) if len(high) > 1 else F.col(high[0])
    return F.max(greatest) - F.min(least)


# Projects: time


def ages(h: History) -> DataFrame:
    """Seconds between a project's first and last author or committer time."""
    return h.full_commits.groupBy("project_id").agg(_span(["author_time", "committer_time"]).alias("age"))


def commit_gaps(h: History, compat: bool = False) -> DataFrame:
    """Largest and mean gap between successive committer times; the mean is rounded, 0 for a single commit."""
    times = h.full_commits.where("committer_time IS NOT NULL").select("project_id", "committer_time")
    gaps = Blocks(times, ["project_id"], ["committer_time"]).previous("before", F.col("committer_time")).withColumn("gap", F.col("committer_time") - F.col("before"))
    last, n = F.max("committer_time"), F.count(F.lit(1))
    mean = F.when(n > 2, F.round(F.try_divide(last, n - 1))).otherwise(last) if compat else F.coalesce(F.round(F.try_divide(last - F.min("committer_time"), n - 1)), F.lit(0))
    return gaps.groupBy("project_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"), mean.cast("long").alias("mean_gap"))


def update_state(h: History) -> DataFrame:
    """latest_update (-1 when the newest log row is an error) and is_valid."""
    newest = h.project_logs.groupBy("project_id").agg(F.max(F.struct("time", (~F.col("is_error")).alias("valid"))).alias("n"))
    return newest.select("project_id", F.when(F.col("n.valid"), F.col("n.time")).otherwise(-1).alias("latest_update"), F.col("n.valid").alias("is_valid"))


def activity(h: History, gaps: DataFrame | None = None) -> DataFrame:
    """Seconds from the first and the last commit to the latest update (0 when invalid), and whether the project is abandoned:
    quiet for longer than its largest gap. gaps: commit_gaps, where they are there already."""
    ends = h.full_commits.groupBy("project_id").agg(F.min("committer_time").alias("first"), F.max("committer_time").alias("last"))
    joined = ends.join(update_state(h), "project_id").join(commit_gaps(h) if gaps is None else gaps, "project_id")
    since = lambda c: F.when(F.col("latest_update") > 0, F.col("latest_update") - F.col(c)).otherwise(0)
    return joined.select("project_id", since("first").alias("since_first"), since("last").alias("since_last"), (since("last") > F.col("max_gap")).alias("is_abandoned"))


def end_commits(h: History) -> DataFrame:
    """oldest and newest commit by committer time; a missing time is the oldest, ties go to the first and the last id."""
    key = F.struct("committer_time", "commit_id")
    return h.full_commits.groupBy("project_id").agg(F.min(key)["commit_id"].alias("oldest"), F.max(key)["commit_id"].alias("newest"))


# Projects: counts


def counts(h: History) -> DataFrame:
    """Commits, authors, committers, users (either), of each project."""
    commits = h.full_commits.groupBy("project_id").agg(F.count(F.lit(1)).alias("commits"))
    role = lambda c: F.struct(F.col(c).alias("user_id"), F.lit(c == "author_id").alias("author"))
    people = h.full_commits.select("project_id", F.explode(F.array(role("author_id"), role("committer_id"))).alias("p")).select("project_id", "p.*")
    roles = people.where("user_id IS NOT NULL").repartitionByRange("project_id", "user_id").groupBy("project_id", "user_id").agg(F.max("author").alias("author"), F.max(~F.col("author")).alias("committer"))
    users = roles.groupBy("project_id").agg(F.count_if("author").alias("authors"), F.count_if("committer").alias("committers"), F.count(F.lit(1)).alias("users"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return commits.join(users, "project_id", "left").select("project_id", "commits", none("authors"), none("committers"), none("users"))


def holdings(h: History) -> DataFrame:
    """(project_id, snapshot_id, first, created, listed, known): each snapshot that a project ever held, by the first author time of its
    commits there; whether any of them has a row, and the project's time of creation and whether it has a row."""
    owners = h.project_commits.join(h.projects.select("project_id", "created", F.lit(True).alias("listed")), "project_id", "left")
    dated = h.commits.select("commit_id", "author_time", F.lit(True).alias("known"))
    held = owners.join(h.commit_changes.where("snapshot_id IS NOT NULL"), "commit_id").join(dated, "commit_id", "left")
    held = dealt_by(held.select("project_id", "snapshot_id", "author_time", "created", "listed", "known"), ["project_id", "snapshot_id"], h.commit_changes)
    return held.groupBy("project_id", "snapshot_id").agg(F.min("author_time").alias("first"), F.first("created").alias("created"), F.first("listed").alias("listed"), F.max("known").alias("known"))


def content_counts(h: History, held: DataFrame | None = None) -> DataFrame:
    """Paths ever changed (deletions too) and snapshots with stored contents, of each project. held: holdings, where they are there
    already."""
    # Each kind of ids by itself: counted at once, every change would be a row for both in one task's memory.
    paths = distinct_of(h.full_changes.select("project_id", "path_id"), h.commit_changes).groupBy("project_id").agg(F.count("path_id").alias("paths"))
    stored = materialized(h.snapshots.select("snapshot_id"))
    if held is None:
        held = distinct_of(h.full_changes.where("snapshot_id IS NOT NULL").select("project_id", "snapshot_id"), h.commit_changes)
    snapshots = held.join(stored, "snapshot_id", "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("snapshots"))
    return paths.join(snapshots, "project_id", "left").select("project_id", "paths", F.coalesce("snapshots", F.lit(0)).cast("long").alias("snapshots"))


# Projects: contributions


def contributions(h: History, of: str = "commits") -> DataFrame:
    """(project_id, author_id, n, place, percent): authors by their commits or changes, the most first (ties: smaller id), and
    the running percentage, rounded down."""
    rows = h.full_commits.select("project_id", "commit_id", "author_id").where("project_id IS NOT NULL AND author_id IS NOT NULL")
    if of == "changes":
        rows = rows.join(h.commit_changes.groupBy("commit_id").agg(F.count(F.lit(1)).alias("each")), "commit_id")
    n = rows.groupBy("project_id", "author_id").agg((F.sum("each") if of == "changes" else F.count(F.lit(1))).alias("n"))
    summed = Blocks(n, ["project_id"], [F.desc("n"), "author_id"]).runnings({"running": F.col("n"), "place": F.lit(1)}, wholes={"whole": F.col("n")})
    return summed.select("project_id", "author_id", "n", "place", F.floor(100 * F.col("running") / F.col("whole")).cast("long").alias("percent"), "running", "whole")


def main_contributors(h: History, percent: int, of: str = "commits") -> DataFrame:
    """(project_id, author_id): the fewest authors who together reach the percentage, rounded down; at least one."""
    return contributions(h, of).where(_is_main(percent)).select("project_id", "author_id")


def main_contributor_counts(h: History, percents: tuple[int, ...], of: str = "commits") -> DataFrame:
    """How many main_contributors each project has, for several percentages of the same contributions."""
    each = [F.count_if(_is_main(p)).alias(f"authors_contributing_{p}%_{of}") for p in percents]
    return contributions(h, of).groupBy("project_id").agg(*each)


def _is_main(percent: int) -> Column:
    needed = F.floor(F.lit(percent) * F.col("whole") / 100)
    return (F.col("running") - F.col("n") < needed) | (F.col("place") == 1)


# Users


def user_times(h: History) -> DataFrame:
    """Experience by author time, by committer time (of committed commits) and by both, and the lifetime's ends."""
    c = h.commits
    authored = c.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("user_id")).agg(_span(["author_time"]).alias("author_experience"), F.min("author_time").alias("first"), F.max("author_time").alias("last"), F.count(F.lit(1)).alias("authored"))
    committed = c.where("committer_id IS NOT NULL").groupBy(F.col("committer_id").alias("user_id")).agg(_span(["committer_time"]).alias("committer_experience"), F.count(F.lit(1)).alias("committed"), F.min("committer_time").alias("cf"), F.max("committer_time").alias("cl"))
    both = authored.join(committed, "user_id", "full")
    return both.select("user_id", "author_experience", "committer_experience", (F.greatest("last", "cl") - F.least("first", "cf")).alias("experience"), "first", "last", F.coalesce("authored", F.lit(0)).alias("authored"), F.coalesce("committed", F.lit(0)).alias("committed"))


def _h_index(counts: DataFrame, by: str, value: str, name: str, offset: int) -> DataFrame:
    """The greatest k such that k values are at least k - offset.

    Values are counted first. A group has no more different values than the root of twice its sum, so a list of them is small.
    """
    each = counts.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("v", "c")), asc=False).alias("falling"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    step = lambda a, x: F.struct((a["n"] + x["c"]).alias("n"), F.greatest(a["k"], F.least(x["v"] + offset, a["n"] + x["c"])).alias("k"))
    return each.select(by, F.aggregate("falling", start, step)["k"].alias(name))


def h_indices(h: History, compat: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """h_index1: the largest k such that k projects have k own commits each; h_index2: the same of the lesser of own commits
    and the project's users. compat counts ranks from 0. sizes: counts, where they are there already."""
    own = h.full_commits.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("user_id"), "project_id").agg(F.countDistinct("commit_id").alias("k"))
    own = own.join((counts(h) if sizes is None else sizes).select("project_id", "users"), "project_id").withColumn("j", F.least("k", "users"))
    return _h_index(own, "user_id", "k", "h_index1", int(compat)).join(_h_index(own, "user_id", "j", "h_index2", int(compat)), "user_id")


def developer_experience(h: History, compat: bool = False) -> DataFrame:
    """The h-index of a user's commits by 30-day months from the first one. compat: months a second longer, and one more (but
    no more than there are months)."""
    month = 2_592_001 if compat else 2_592_000
    dated = h.commits.where("author_id IS NOT NULL AND author_time IS NOT NULL").select("author_id", "author_time")
    first = dated.groupBy("author_id").agg(F.min("author_time").alias("first"))
    months = dated.join(first, "author_id").withColumn("month", F.floor((F.col("author_time") - F.col("first")) / month))
    per = months.groupBy(F.col("author_id").alias("user_id"), "month").agg(F.count(F.lit(1)).alias("k"))
    index = _h_index(per, "user_id", "k", "h", 0)
    if not compat:
        return index.withColumnRenamed("h", "developer_experience")
    return index.join(per.groupBy("user_id").agg(F.count(F.lit(1)).alias("months")), "user_id").select("user_id", F.least(F.col("h") + 1, F.col("months")).alias("developer_experience"))


def project_experience(h: History, sizes: DataFrame | None = None) -> DataFrame:
    """Of each project: mean developer experience over its commits, and the greatest experience, lifetime and h-indices of
    its authors. sizes: counts, where they are there already."""
    dev, life, hs = developer_experience(h), user_times(h).select("user_id", (F.col("last") - F.col("first")).alias("lifetime")), h_indices(h, sizes=sizes)
    authored = h.full_commits.where("author_id IS NOT NULL").groupBy("project_id", F.col("author_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = authored.join(dev, "user_id").join(life, "user_id").join(hs, "user_id")
    return joined.groupBy("project_id").agg(
        F.try_divide(F.sum(F.col("n") * F.col("developer_experience")), F.sum("n")).alias("mean_experience"), F.max("developer_experience").alias("max_experience"),
        F.max("lifetime").alias("max_lifetime"), F.max("h_index1").alias("max_h_index1"), F.max("h_index2").alias("max_h_index2"),
    )


def user_projects(h: History) -> DataFrame:
    """(user_id, project_id) with an authored commit."""
    return h.full_commits.where("author_id IS NOT NULL").select(F.col("author_id").alias("user_id"), "project_id").distinct()


# Languages


def path_languages(h: History) -> DataFrame:
    return h.paths.select("path_id", language_of_path(F.col("location")).alias("language"))


def language_composition(h: History) -> DataFrame:
    """(project_id, language, n, place): languages by changes, ties in the fixed order; paths without a language are left out."""
    n = h.full_changes.join(path_languages(h).where("language IS NOT NULL"), "path_id").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), ordinal(F.col("language")))))


def major_language(h: History) -> DataFrame:
    """The first language of the composition, its changes, and their share."""
    c = language_composition(h)
    return c.groupBy("project_id").agg(F.min_by("language", "place").alias("language"), F.max("n").alias("changes"), F.try_divide(F.max("n"), F.sum("n")).alias("share"))


def commit_languages(h: History) -> DataFrame:
    """(commit_id, language) of the changed paths, each once."""
    return h.commit_changes.join(path_languages(h).where("language IS NOT NULL"), "path_id").select("commit_id", "language").distinct()


# Originality


def snapshot_origins(h: History, held: DataFrame | None = None) -> DataFrame:
    """Per snapshot: projects that ever held it, and the one created first (ties: first commit, then id); projects without a
    creation time come last. held: holdings, where they are there already."""
    dated = (holdings(h) if held is None else held).where("listed AND known")
    key = F.struct(F.col("created").isNull().alias("none"), "created", "first", "project_id")
    return dated.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("copies"), F.min(key)["project_id"].alias("original"))


def originality(h: History, held: DataFrame | None = None) -> DataFrame:
    """Per project, over its distinct snapshots with contents: unique (in no other project), original (first here, copied
    elsewhere), impact (holders of those first here), and the percentage that another project had first, rounded down.
    held: holdings, where they are there already."""
    held = materialized(holdings(h)) if held is None else held
    origins = materialized(snapshot_origins(h, held).join(h.snapshots.select("snapshot_id"), "snapshot_id", "left_semi"))
    mine = held.select("project_id", "snapshot_id")
    here = F.col("original") == F.col("project_id")
    return join_frequent(mine, origins, "snapshot_id", "copies").groupBy("project_id").agg(
        F.count_if(F.col("copies") == 1).alias("unique_files"), F.count_if(here & (F.col("copies") > 1)).alias("original_files"),
        F.sum(F.when(here, F.col("copies")).otherwise(0)).alias("impact"), F.floor(100 * F.count_if(~here) / F.count(F.lit(1))).cast("long").alias("duplicated_code"),
    )


def fork_families(h: History) -> DataFrame:
    """(root_id, project_id, place, members): for each commit without a parent the projects that have it, by creation (ties: id),
    from 1. The forks of a project are those after it in its families; this table has a row for each, not for each pair.

    Projects that share a commit share all its ancestors, so those of a family, and only they, share commits. Projects without a
    time of creation are in none.
    """
    dated = h.project_roots.join(h.projects.select("project_id", "created"), "project_id").where("created IS NOT NULL")
    placed = Blocks(dated, ["root_id"], ["created", "project_id"]).running("place", F.lit(1))
    members = placed.groupBy(F.col("root_id").alias("of")).agg(F.count(F.lit(1)).alias("members"))
    return placed.join(members, F.col("root_id") == F.col("of")).select("root_id", "project_id", "place", "members")


def fork_counts(h: History) -> DataFrame:
    """(project_id, forks): how many forks each project has. Only those of projects of several families are listed for it."""
    families = materialized(fork_families(h))
    several = families.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("project_id")
    one = families.join(several, "project_id", "left_anti").select("project_id", (F.col("members") - F.col("place")).alias("forks"))
    listed = several.join(_forks_in(families, families.join(several, "project_id", "left_semi")).groupBy("project_id").agg(F.count(F.lit(1)).alias("forks")), "project_id", "left")
    return one.unionByName(listed.select("project_id", F.coalesce("forks", F.lit(0)).cast("long").alias("forks")))


def forks(h: History, of: DataFrame | None = None) -> DataFrame:
    """(project_id, fork_id): projects that share a commit with this one and were created later (ties: larger id). of:
    (project_id), the only projects whose forks are listed. All of them are as many as pairs in the families."""
    families = materialized(fork_families(h))
    return _forks_in(families, families if of is None else families.join(of.select("project_id").distinct(), "project_id", "left_semi"))


def _forks_in(families: DataFrame, mine: DataFrame) -> DataFrame:
    other = families.select(F.col("root_id").alias("of"), F.col("project_id").alias("fork_id"), F.col("place").alias("later"))
    return mine.join(other, F.expr("root_id = of AND later > place")).select("project_id", "fork_id").distinct()


def commit_projects(h: History) -> DataFrame:
    """The number of projects that hold a commit."""
    return h.project_commits.groupBy("commit_id").agg(F.count(F.lit(1)).alias("projects"))


# Trees


def commit_trees(h: History, commits: DataFrame, deletions: bool = False) -> DataFrame:
    """(commit_id, path_id, snapshot_id): the files as of each of the commits, found once for all heads that stand on it."""
    seeds = commits.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node")).distinct()
    return trees_of(h, seeds, deletions).withColumnRenamed("seed", "commit_id")


def trees_of(h: History, seeds: DataFrame, deletions: bool = False) -> DataFrame:
    """The trees of seeds (seed, node, ...), with their further columns. Times are read only where branches must be told apart by them."""
    times = lambda: h.commits.select(F.col("commit_id").alias("node"), F.col("committer_time").alias("time"))
    return trees(h.chains, seeds, h.commit_changes, times, deletions)


def head_trees(h: History, heads: DataFrame | None = None) -> DataFrame:
    """(project_id, name, path_id, snapshot_id): the files of each head (by default all), without deleted ones."""
    heads = h.project_heads if heads is None else heads
    seeds = heads.select(F.col("commit_id").alias("seed"), F.col("commit_id").alias("node"), "project_id", "name")
    return trees_of(h, seeds).select("project_id", "name", "path_id", "snapshot_id")


def snapshot_locs(h: History) -> DataFrame:
    return h.snapshots.select("snapshot_id", lines_of_code(F.col("contents")).alias("locs"))


def default_heads(h: History) -> DataFrame:
    """(project_id, name, commit_id): the head of the branch that a project's metadata name as the default."""
    branch = h.metadata.select("project_id", F.concat(F.lit("refs/heads/"), "default_branch").alias("branch"))
    return h.project_heads.join(branch, "project_id").where("name = branch").select("project_id", "name", "commit_id")


def default_commits(h: History) -> DataFrame:
    """The default heads' commits, with their fields."""
    return default_heads(h).join(h.commits, "commit_id")


def default_trees(h: History) -> DataFrame:
    """The files of each default head, without deleted ones."""
    return head_trees(h, default_heads(h))


def project_locs(h: History) -> DataFrame:
    """Line ends over the files of the default branch's head."""
    # Counted once for each snapshot and written: so small a table goes to the trees' rows, which stay where they are.
    return default_trees(h).join(materialized(snapshot_locs(h)), "snapshot_id").groupBy("project_id").agg(F.sum("locs").alias("locs"))
