"""Queries over collections of entities, layouts and compositions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import composition, formats, statistics
from ..functions.languages import language_of_name
from ..operators import entities, metrics
from ..operators.sampling import DistinctRandom, MinRatio, Stratified, Top
from ..operators.selection import Selection, classify_by, dropped, side
from ..sources.history import History
from ..sources.layouts import change_rows, head_rows, metadata_rows
from .queries import _DEFAULT, of_history, query, table

_PEOPLE = {"author": "author_id", "committer": "committer_id", "user": "unnest([author_id, committer_id])"}
_CONTENTS = "md5(contents)"


def _people(role: str, of: str) -> None:
    ids = f"SELECT DISTINCT project_id, user_id FROM (SELECT project_id, {of} AS user_id FROM pcc) WHERE user_id IS NOT NULL"

    def all_ids(h: History) -> DataFrame:
        return entities.project_people(h, role)

    def addresses(h: History) -> DataFrame:
        return entities.users_of(h, entities.project_people(h, role)).select("project_id", "user_id", "email")

    all_ids.__name__, addresses.__name__ = f"project_{role}_ids", f"project_{role}s"
    of_history(ids)(all_ids)
    of_history(f"SELECT project_id, user_id, email FROM ({ids}) JOIN users USING (user_id)")(addresses)


for _role, _of in _PEOPLE.items():
    _people(_role, _of)

_PROJECT_SNAPSHOTS = "SELECT DISTINCT project_id, snapshot_id FROM pch WHERE snapshot_id IS NOT NULL"


@of_history("SELECT DISTINCT project_id, path_id FROM pch")
def project_path_ids(h: History) -> DataFrame:
    return entities.project_paths(h)


@of_history("SELECT DISTINCT project_id, location FROM pch JOIN paths USING (path_id)")
def project_paths(h: History) -> DataFrame:
    return entities.paths_of(h, entities.project_paths(h)).select("project_id", "location").distinct()


@of_history(_PROJECT_SNAPSHOTS)
def project_snapshot_ids(h: History) -> DataFrame:
    return entities.project_snapshots(h)


@of_history(f"SELECT project_id, snapshot_id, {_CONTENTS} AS contents FROM ({_PROJECT_SNAPSHOTS}) JOIN snapshots USING (snapshot_id)")
def project_snapshots(h: History) -> DataFrame:
    return entities.snapshots_of(h, entities.project_snapshots(h), contents=F.md5("contents")).select("project_id", "snapshot_id", "contents")


@of_history("SELECT DISTINCT author_id AS user_id, commit_id, message FROM commits WHERE author_id IS NOT NULL")
def authored_commits(h: History) -> DataFrame:
    return entities.commits_of(h, entities.user_commits(h, "author")).select("user_id", "commit_id", "message")


@of_history("SELECT DISTINCT committer_id AS user_id, commit_id, message FROM commits WHERE committer_id IS NOT NULL")
def committed_commits(h: History) -> DataFrame:
    return entities.commits_of(h, entities.user_commits(h, "committer")).select("user_id", "commit_id", "message")


_ANCESTORS = "(WITH RECURSIVE a AS (SELECT DISTINCT commit_id AS head, commit_id FROM project_heads UNION SELECT a.head, p.parent_id FROM a JOIN commit_parents p ON p.commit_id = a.commit_id) SELECT head, commit_id FROM a)"


@of_history(f"SELECT project_id, name, a.commit_id FROM project_heads h JOIN {_ANCESTORS} a ON a.head = h.commit_id")
def head_commits(h: History) -> DataFrame:
    return entities.head_commits(h)


@of_history(f"SELECT head AS of, commit_id, hash FROM {_ANCESTORS} JOIN commits USING (commit_id)")
def preceding_commits_with_data(h: History) -> DataFrame:
    return entities.commits_of(h, entities.preceding_commits(h, h.project_heads)).select("of", "commit_id", "hash")


@of_history("SELECT p.commit_id, pos, hash AS parent_hash FROM commit_parents p JOIN commits c ON c.commit_id = parent_id")
def commit_parents_with_data(h: History) -> DataFrame:
    return entities.commit_parents(h).select("commit_id", "pos", "parent_hash")


@of_history("SELECT commit_id, location FROM commit_changes JOIN paths USING (path_id)")
def commit_paths(h: History) -> DataFrame:
    return entities.paths_of(h, h.commit_changes).select("commit_id", "location")


@of_history(f"SELECT commit_id, path_id, {_CONTENTS} AS contents FROM commit_changes JOIN snapshots USING (snapshot_id)")
def commit_snapshots(h: History) -> DataFrame:
    return entities.snapshots_of(h, h.commit_changes, contents=F.md5("contents")).select("commit_id", "path_id", "contents")


@of_history(f"SELECT project_id, name, author_id, message FROM {_DEFAULT} JOIN commits USING (commit_id)")
def head_commit(h: History) -> DataFrame:
    return entities.commits_of(h, metrics.default_heads(h)).select("project_id", "name", "author_id", "message")


# Layouts


@of_history("SELECT path_id, snapshot_id FROM commit_changes")
def change_layout(h: History) -> DataFrame:
    return change_rows(h)


@of_history("SELECT name, commit_id, hash FROM project_heads LEFT JOIN (SELECT commit_id, hash FROM commits) USING (commit_id)")
def head_layout(h: History) -> DataFrame:
    return head_rows(h)


_M = {"is_fork": ("fork", "BOOLEAN"), "is_archived": ("archived", "BOOLEAN"), "is_disabled": ("disabled", "BOOLEAN"), "star_gazers": ("stargazers_count", "BIGINT"), "watchers": ("watchers_count", "BIGINT"), "size": ("size", "BIGINT"), "open_issues": ("open_issues_count", "BIGINT"), "forks": ("forks", "BIGINT"), "subscribers": ("subscribers_count", "BIGINT")}
_M |= {c: (c, "VARCHAR") for c in ("description", "homepage")} | {f"has_{c}": (f"has_{c}", "BOOLEAN") for c in ("issues", "downloads", "wiki", "pages")} | {"master": ("default_branch", "VARCHAR")}
_LANGUAGE = "CASE lower(j->>'language') WHEN 'c++' THEN 'Cpp' WHEN 'python' THEN 'Python' WHEN 'perl 6' THEN 'Perl' WHEN 'rust' THEN 'Rust' END AS language"


@of_history(
    "SELECT project_id, " + ", ".join(f"(j->>'{f}')::{t} AS {c}" for c, (f, t) in _M.items()) + f", {_LANGUAGE}, j->'license'->>'name' AS license, "
    + ", ".join(f"epoch((j->>'{c}_at')::TIMESTAMP)::BIGINT AS {c}" for c in ("created", "updated", "pushed")) + " FROM (SELECT project_id, json::JSON AS j FROM project_metadata)"
)
def metadata_layout(h: History) -> DataFrame:
    return metadata_rows(h)


# Composition


@query("SELECT c_custkey, c_name AS name, count(*) FILTER (o_totalprice IS NOT NULL) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def selected_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of an entity, the values of each of its orders, their ends, and all of them selected as one struct."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("customer", F.struct("c_custkey", "c_name"))
    prices = composition.from_each(F.col("orders"), lambda o: o["o_totalprice"])
    ends = statistics.min_max(prices)
    chosen = composition.select(name=composition.from_entity(F.col("customer"), "c_name"), n=F.coalesce(F.size(prices).cast("long"), F.lit(0)), low=ends["min"], high=ends["max"])
    chosen = F.when(F.col("orders").isNull(), composition.select(name=F.col("c_name"), n=F.lit(0).cast("long"), low=F.lit(None).cast("double"), high=F.lit(None).cast("double"))).otherwise(chosen)
    return rows.select("c_custkey", chosen.alias("s")).select("c_custkey", "s.*")


@query("SELECT o_orderkey, o_custkey AS left_side, o_orderpriority AS right_side, list_transform([o_custkey, o_orderkey], lambda x: x + 1) AS firsts FROM orders")
def sides_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side of pairs: of a struct, and of each struct in a list."""
    pair = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))
    pairs = F.array(F.struct((F.col("o_custkey") + 1).alias("a"), F.lit("x").alias("b")), F.struct((F.col("o_orderkey") + 1).alias("a"), F.lit("y").alias("b")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pair.alias("pair"), pairs.alias("pairs"))
    return rows.select("o_orderkey", side(rows, "pair", 0).alias("left_side"), dropped(rows, "pair", 0)["b"].alias("right_side"), side(rows, "pairs", 0).alias("firsts"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey % 2 ORDER BY c_custkey) AS r FROM customer) WHERE r <= CASE WHEN c_nationkey % 2 = 0 THEN 5 ELSE 7 END")
def sample_custom_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata named by a function."""
    strata = classify_by(lambda nation: F.when(nation % 2 == 0, "even").otherwise("odd"), F.col("c_nationkey"))
    rows = Selection.of(table(spark, sf_dir, "customer").withColumn("stratum", strata), "c_custkey")
    return rows.sample(Stratified("stratum", {"even": Top(5), "odd": Top(7)})).map_into("c_custkey", "stratum")


@query("SELECT segment, c_custkey FROM (SELECT c_mktsegment AS segment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer WHERE c_custkey % 2 = 0) WHERE r <= 5")
def sample_min_ratio_of_equal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in pairs of equal sets: of each pair the one with the greater id is kept, and an inner sampler takes of these."""
    rows = table(spark, sf_dir, "customer").withColumn("e", F.array(F.floor((F.col("c_custkey") + 1) / 2)))
    by_id = Selection.of(rows, "c_custkey").group_by(segment=F.lit("all")).sort_by(F.col("c_custkey")).sample(MinRatio(0, "e", 0.5, "c_custkey", inner=Top(1 << 30)))
    return Selection.of(by_id.rows, "c_custkey").group_by(segment=F.col("c_mktsegment")).sample(Top(5)).map_into("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, h, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) AS k FROM (SELECT c_custkey, c_nationkey, md5('8:' || c_custkey) AS h FROM customer)) WHERE k = 1 ORDER BY h, c_custkey LIMIT 20")
def sample_distinct_random_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a random order, customers whose set is not that of one drawn before."""
    rows = table(spark, sf_dir, "customer").withColumn("e", F.array("c_nationkey"))
    return Selection.of(rows, "c_custkey").sample(DistinctRandom(20, 8, "c_custkey", MinRatio(0, "e", 0.9, "c_custkey"))).map_into("c_custkey")


@query("SELECT o_orderkey, (o_orderkey % 90)::VARCHAR || '%' AS percent, '\"' || replace(o_orderpriority, '\"', '\"\"') || '\"' AS quoted, o_orderpriority || ', ' || o_orderstatus AS joined FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00'")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages, quotes, joined texts, and a date literal."""
    since = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) >= formats.timestamp(1995, "March")
    rows = table(spark, sf_dir, "orders").where(since)
    return rows.select("o_orderkey", formats.percent_text(F.col("o_orderkey") % 90).alias("percent"), formats.quoted(F.col("o_orderpriority")).alias("quoted"), formats.joined(F.array("o_orderpriority", "o_orderstatus"), ", ").alias("joined"))


_SPELT = " || ".join(f"CASE WHEN s // {size} % {of} = 0 THEN '' ELSE (s // {size} % {of})::VARCHAR || ' {name}' END" for size, of, name in ((31_104_000, 1 << 40, "years"), (2_592_000, 12, "months"), (86_400, 30, "days"), (3600, 24, "hours"), (60, 60, "minutes"), (1, 60, "seconds")))


@query(f"SELECT event_id, CASE WHEN s = 0 THEN '0 seconds' ELSE {_SPELT} END AS text FROM (SELECT event_id, event_id * event_id * 37 % 90000000 AS s FROM events)")
def spelt_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id") * F.col("event_id") * 37 % 90_000_000
    return table(spark, sf_dir, "events").select("event_id", formats.spelt_duration(s).alias("text"))


@of_history(f"SELECT language, count(*) AS n FROM (SELECT {_LANGUAGE} FROM (SELECT json::JSON AS j FROM project_metadata)) GROUP BY language")
def projects_of_languages(h: History) -> DataFrame:
    return h.metadata.groupBy(language_of_name(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
