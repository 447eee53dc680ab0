"""The registered queries, one for each operator, and their DuckDB SQL. Roles of the driver's tables: binding.py."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import composition, formats, predicates, statistics
from ..functions.languages import display_name, language_of_name, language_of_path
from ..operators import entities, metrics
from ..operators.blocks import order_statistics
from ..operators.sampling import Distinct, DistinctRandom, MinRatio, Random, Stratified, Top
from ..operators.selection import Selection, classify, products
from ..shipping import ship
from ..sources.history import NAMES, History
from ..sources.layouts import commit_rows, path_rows, project_rows, snapshot_rows, tree_rows, user_rows
from ..sources.sinks import ids_from_csv, into_csv, round_trip_csv
from ..sources.stores import ById, merged, write_by_id
from ..sources.tables import Lazy, bucketed, materialized, shared_path
from .binding import PRELUDE, SOURCES, spark_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_opened: dict[tuple, History] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DEALT_BYTES = 8 << 20


class _Bound(History):
    @cached_property
    def project_commits(self) -> DataFrame:
        return materialized(super().project_commits)


def history(spark: SparkSession, sf_dir: str) -> History:
    """The history bound to the tables in sf_dir. What is derived from them is written once for each application and state of
    their files, when a query first needs it."""
    files = {name: _files(spark, f"{sf_dir}/{name}.parquet") for name in SOURCES}
    key = (spark.sparkContext.applicationId, *(f for name in SOURCES for f in files[name]))
    if key not in _opened:
        ship(spark)
        for name in SOURCES:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        # Dealt by commit before it is grouped, so that no task's groups grow with the table. What comes of it stays dealt so.
        dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + sum(length for _, length, _ in files["lineitem"]) // _DEALT_BYTES)
        table(spark, sf_dir, "lineitem").repartition(dealt, "l_orderkey").createOrReplaceTempView("lineitem")
        plain = {name: spark.sql(spark_sql(name)) for name in NAMES}
        made = {"commit_changes": lambda df: bucketed(df, "commit_id", dealt), "commits": lambda df: bucketed(df, "commit_id", dealt), "commit_parents": materialized, "project_heads": materialized}
        _opened[key] = _Bound(Lazy({name: lambda name=name: made.get(name, lambda df: df)(plain[name]) for name in NAMES}))
    return _opened[key]


def _files(spark: SparkSession, path: str) -> list[tuple]:
    """Path, length and time of change of the files of a table, as its store lists them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(folder)]


def query(sql: str | None = None, prelude: bool = False):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{PRELUDE}{sql}" if prelude else sql
        return f

    return add


def of_history(sql: str):
    """As query, for functions of a History."""

    def add(f: Callable[[History], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(history(spark, sf_dir))
        SQL[f.__name__] = PRELUDE + sql
        return f

    return add


# Predicates, on documents with labels where there are any


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "of")
    return table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("of"), "left").drop("of")


def _predicate(name: str, condition: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Selection.of(_labelled(spark, sf_dir), "doc_id").filter_by(condition()).map_into(F.col("doc_id"))

    QUERIES[f"filter_{name}"] = run
    SQL[f"filter_{name}"] = f"SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE {sql}"


_q, _text = (lambda: F.col("quality")), (lambda: F.col("text"))
_predicate("less_than", lambda: predicates.less_than(_q(), 1), "quality < 1")
_predicate("at_most", lambda: predicates.at_most(_q(), 0), "quality <= 0")
_predicate("equal", lambda: predicates.equal(_q(), 1), "quality = 1")
_predicate("at_least", lambda: predicates.at_least(_q(), 1), "quality >= 1 OR quality IS NULL")
_predicate("more_than", lambda: predicates.more_than(_q(), 0), "quality > 0 OR quality IS NULL")
_predicate("at_least_strict", lambda: predicates.at_least(_q(), 1, missing=False), "quality >= 1")
_predicate("not", lambda: predicates.negated(predicates.equal(_q(), 1)), "quality IS NULL OR quality <> 1")
_predicate("and", lambda: predicates.equal(_q(), 1) & predicates.equal(F.col("toxic"), 0), "quality = 1 AND toxic = 0")
_predicate("or", lambda: predicates.equal(_q(), 0) | predicates.missing(F.col("toxic")), "quality = 0 OR toxic IS NULL")
_predicate("exists", lambda: predicates.exists(_q()), "quality IS NOT NULL")
_predicate("missing", lambda: predicates.missing(_q()), "quality IS NULL")
_predicate("same", lambda: predicates.same(F.col("lang"), "fr"), "lang = 'fr'")
_predicate("contains", lambda: predicates.contains(_text(), "tion"), "contains(text, 'tion')")
_predicate("matches", lambda: predicates.matches(_text(), "[0-9]{2}"), "regexp_matches(text, '[0-9]{2}')")
_predicate("member", lambda: predicates.member(F.col("lang"), ["de", "es"]), "lang IN ('de', 'es')")
_predicate("flag", lambda: predicates.holds(F.col("toxic") == 1), "toxic = 1")

_languages = "SELECT o_custkey, list(DISTINCT o_orderpriority) AS a FROM orders GROUP BY o_custkey"


def _array_predicate(name: str, condition: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        arrays = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
        customers = table(spark, sf_dir, "customer").select("c_custkey").join(arrays, F.col("c_custkey") == F.col("o_custkey"), "left")
        return customers.where(condition(F.col("a"))).select("c_custkey")

    QUERIES[f"filter_{name}"] = run
    SQL[f"filter_{name}"] = f"SELECT c_custkey FROM customer LEFT JOIN ({_languages}) ON c_custkey = o_custkey WHERE {sql}"


_two = ["1-URGENT", "2-HIGH"]
_array_predicate("any_in", lambda a: predicates.any_in(a, _two), "list_has_any(a, ['1-URGENT', '2-HIGH'])")
_array_predicate("all_in", lambda a: predicates.all_in(a, [*_two, "3-MEDIUM", "5-LOW"]), "list_has_all(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'], a)")
_array_predicate("within", lambda a: predicates.within(a, "5-LOW"), "list_contains(a, '5-LOW')")
_array_predicate("any_within", lambda a: predicates.any_within(a, _two), "list_has_any(a, ['1-URGENT', '2-HIGH'])")
_array_predicate("all_within", lambda a: predicates.all_within(a, _two), "list_has_all(a, ['1-URGENT', '2-HIGH'])")
_array_predicate("all_within_none", lambda a: predicates.all_within(a, []), "true")


# Verbs


def _customers(spark: SparkSession, sf_dir: str) -> Selection:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return Selection.of(rows, "c_custkey")


_CUSTOMERS = "SELECT c.*, n_orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"


@query(f"SELECT segment, c_custkey, c_name FROM (SELECT c_mktsegment AS segment, c_custkey, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS r FROM ({_CUSTOMERS}) WHERE n_orders >= 5 OR n_orders IS NULL) WHERE r <= 50")
def top_projects_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group by language, keep projects of at least five commits, sort by stars, the first 50 of each group, id and URL."""
    grouped = _customers(spark, sf_dir).group_by(segment=F.col("c_mktsegment")).filter_by(predicates.at_least(F.col("n_orders"), 5))
    return grouped.sort_by(F.col("c_acctbal")).sample(Top(50)).map_into(F.col("c_custkey"), F.col("c_name"))


def _ranked(name: str, ascending: bool, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _customers(spark, sf_dir).sort_by(F.col("n_orders"), ascending).sample(Top(100)).map_into("c_custkey", "n_orders")

    QUERIES[name] = run
    SQL[name] = f"SELECT c_custkey, n_orders FROM ({_CUSTOMERS}) ORDER BY {order} LIMIT 100"


_ranked("sort_descending_top", False, "n_orders DESC NULLS LAST, c_custkey DESC")
_ranked("sort_ascending_top", True, "n_orders ASC NULLS FIRST, c_custkey ASC")


@query(f"SELECT segment, c_custkey, rank FROM (SELECT c_mktsegment AS segment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey DESC) AS rank FROM ({_CUSTOMERS}))")
def sort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorting by balance, then by nation: ties of the second sort keep the order of the first."""
    rows = _customers(spark, sf_dir).group_by(segment=F.col("c_mktsegment")).sort_by(F.col("c_acctbal")).sort_by(F.col("c_nationkey"), ascending=True)
    return rows.numbered().select("segment", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def group_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.of(_labelled(spark, sf_dir), "doc_id").group_by(quality=F.col("quality")).rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM (SELECT c_custkey, md5('42:' || c_custkey) AS h FROM customer) ORDER BY h, c_custkey LIMIT 50")
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sample(Random(50, 42, "c_custkey")).map_into("c_custkey")


@query("SELECT segment, c_custkey FROM (SELECT c_mktsegment AS segment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 10")
def sample_random_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).group_by(segment=F.col("c_mktsegment")).sample(Random(10, 7, "c_custkey")).map_into("c_custkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id DESC) AS k, n_chars FROM documents) WHERE k = 1 ORDER BY n_chars DESC, doc_id DESC LIMIT 200")
def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.of(table(spark, sf_dir, "documents"), "doc_id").sort_by(F.col("n_chars")).sample(Distinct(Top(200), "text")).map_into("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY text ORDER BY h, doc_id) AS k FROM (SELECT doc_id, text, md5('5:' || doc_id) AS h FROM documents)) WHERE k = 1 ORDER BY h, doc_id LIMIT 200")
def sample_distinct_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.of(table(spark, sf_dir, "documents"), "doc_id").sample(DistinctRandom(200, 5, "doc_id", "text")).map_into("doc_id")


@query(
    f"SELECT stratum, c_custkey FROM (SELECT stratum, c_custkey, row_number() OVER (PARTITION BY stratum ORDER BY c_acctbal DESC, c_custkey DESC) AS r, row_number() OVER (PARTITION BY stratum ORDER BY md5('3:' || c_custkey), c_custkey) AS m"
    f" FROM (SELECT *, CASE WHEN n_orders IS NULL THEN 'NA' WHEN n_orders >= 15 THEN 'large' WHEN n_orders >= 8 THEN 'medium' ELSE 'small' END AS stratum FROM ({_CUSTOMERS}))) WHERE (stratum IN ('large', 'NA') AND r <= 20) OR (stratum = 'medium' AND m <= 30)"
)
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large and missing strata by balance, the medium one at random; the small one has no sampler."""
    rows = _customers(spark, sf_dir).sort_by(F.col("c_acctbal"))
    strata = rows.group_by(stratum=classify(F.col("n_orders"), [("large", 15), ("medium", 8)], "small")).ungroup()
    return strata.sample(Stratified("stratum", {"large": Top(20), "medium": Random(30, 3, "c_custkey"), "NA": Top(20)})).map_into("stratum", "c_custkey")


def _walk_sql(rows: str, parts: str, n: int, ratio: float) -> str:
    """Tables of a greedy walk by a recursive query; the last one, walked, has each group's kept ids.

    rows: (id, g, r), r being the place in the group, from 1; parts: (id, x), the distinct elements of ids that have a set.
    """
    return f"""cand AS MATERIALIZED ({rows}), parts AS MATERIALIZED ({parts}), sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM parts GROUP BY id),
        pairs AS (SELECT c.g, c.r, c.id, d.id AS other FROM cand c JOIN cand d ON c.g = d.g AND d.r < c.r),
        shared AS (SELECT p.id, p.other, count(*) AS n_both FROM pairs p JOIN parts a ON a.id = p.id JOIN parts b ON b.id = p.other AND b.x = a.x GROUP BY p.id, p.other),
        alike AS (SELECT id, other FROM shared JOIN sizes USING (id) WHERE n_both / n > {ratio} UNION ALL SELECT id, other FROM pairs WHERE id NOT IN (SELECT id FROM sizes) AND other NOT IN (SELECT id FROM sizes)),
        asked AS MATERIALIZED (SELECT g, r, cand.id, coalesce(before, []) AS before FROM cand LEFT JOIN (SELECT id, list(other) AS before FROM alike GROUP BY id) s USING (id)),
        walk AS (SELECT DISTINCT g, 0::BIGINT AS r, []::BIGINT[] AS kept FROM cand UNION ALL SELECT w.g, a.r, CASE WHEN len(w.kept) < {n} AND NOT list_has_any(w.kept, a.before) THEN list_append(w.kept, a.id) ELSE w.kept END FROM walk w JOIN asked a ON a.g = w.g AND a.r = w.r + 1),
        walked AS (SELECT unnest(arg_max(kept, r)) AS id FROM walk GROUP BY g)"""


@query(
    "WITH RECURSIVE "
    + _walk_sql(
        "SELECT c_custkey AS id, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer",
        "SELECT DISTINCT o_custkey AS id, l_partkey % 40 AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey", 50, 0.5,
    )
    + " SELECT c_custkey, c_mktsegment AS segment FROM walked JOIN customer ON c_custkey = id"
)
def sample_min_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each segment, the 50 largest accounts of which none shares more than half its parts with one kept before."""
    ship(spark)
    parts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("parts"))
    rows = table(spark, sf_dir, "customer").join(parts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return Selection.of(rows, "c_custkey").group_by(segment=F.col("c_mktsegment")).sort_by(F.col("c_acctbal")).sample(MinRatio(50, "parts", 0.5, "c_custkey")).map_into("c_custkey")


@query("SELECT c_custkey, priority, status FROM (SELECT c_custkey, p, s FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey), unnest(CASE WHEN p IS NULL THEN [NULL] ELSE p END) AS a(priority), unnest(CASE WHEN s IS NULL THEN [NULL] ELSE s END) AS b(status)")
def row_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priority"), F.collect_set("o_orderstatus").alias("status"))
    rows = table(spark, sf_dir, "customer").join(arrays, F.col("c_custkey") == F.col("o_custkey"), "left")
    return products(rows, "priority", "status", keep=("c_custkey",))


# Statistics and composition


@query(
    "SELECT c_custkey, coalesce(len(a), 0)::BIGINT AS n, len(a)::BIGINT AS n_or_missing, list_min(a) AS least, list_max(a) AS greatest, list_sum(a)::BIGINT AS mean_num, len(a)::BIGINT AS mean_den,"
    " (CASE WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1] ELSE a[len(a) // 2] + a[len(a) // 2 + 1] END)::BIGINT AS median_num, (CASE WHEN len(a) % 2 = 1 THEN 1 WHEN len(a) > 0 THEN 2 END)::BIGINT AS median_den"
    " FROM customer LEFT JOIN (SELECT o_custkey, list(octet_length(encode(o_orderpriority)) * (o_orderkey % 7) ORDER BY octet_length(encode(o_orderpriority)) * (o_orderkey % 7)) AS a FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"
)
def statistics_from_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, minimum, maximum, mean and median of a figure of each project's commits."""
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(statistics.length(F.col("o_orderpriority")) * (F.col("o_orderkey") % 7)).alias("a"))
    rows = table(spark, sf_dir, "customer").join(sizes, F.col("c_custkey") == F.col("o_custkey"), "left")
    a = F.col("a")
    mean, median = statistics.mean(a), statistics.median(a)
    return rows.select(
        "c_custkey", statistics.count(a).alias("n"), statistics.count_or_missing(a).alias("n_or_missing"), statistics.minimum(a).alias("least"), statistics.maximum(a).alias("greatest"),
        mean["num"].alias("mean_num"), mean["den"].alias("mean_den"), median["num"].alias("median_num"), median["den"].alias("median_den"),
    )


@query(
    "SELECT o_custkey, num, den, CASE WHEN num % den = 0 THEN (num // den)::VARCHAR WHEN num // den = 0 THEN num || '/' || den ELSE (num // den) || '+' || (num % den) || '/' || den END AS text, num / den AS value"
    " FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS num, count(*) AS den FROM orders GROUP BY o_custkey)"
)
def ratio_of_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a project's commits that pass a predicate, as a fraction, its text and its value."""
    arrays = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("a"))
    r = statistics.ratio(F.filter("a", lambda s: predicates.same(s, "F")), F.col("a"))
    return arrays.select("o_custkey", r.alias("r")).select("o_custkey", "r.num", "r.den", statistics.fraction_text(F.col("r")).alias("text"), statistics.fraction_value(F.col("r")).alias("value"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS locs, floor(n_chars / 100)::BIGINT AS bucket FROM documents")
def text_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", statistics.length(text).alias("bytes"), statistics.lines_of_code(text).alias("locs"), statistics.bucket(F.col("n_chars"), 100).alias("bucket"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS naive, strftime(o_orderdate, '%a, ') || day(o_orderdate) || strftime(o_orderdate, ' %b %Y %H:%M:%S +0000') AS rfc2822, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc3339 FROM orders")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[formats.format_date(k, t).alias(k) for k in ("naive", "rfc2822", "rfc3339")])


_D = [("yr", 31536000, "mt"), ("mt", 2592000, "wk"), ("wk", 604800, "d"), ("d", 86400, "hr"), ("hr", 3600, "min")]


def _duration_sql() -> str:
    rest, cases, sizes = "s", [], [31536000, 2592000, 604800, 86400, 3600, 60]
    for k, (unit, size, smaller) in enumerate(_D):
        n, m = f"(({rest}) // {size})", f"((({rest}) % {size}) // {sizes[k + 1]})"
        cases.append(f"WHEN {n} <> 0 THEN {n} || '{unit}' || CASE WHEN {m} <> 0 THEN ' ' || {m} || '{smaller}' ELSE '' END")
        rest = f"({rest}) % {size}"
    return f"CASE {' '.join(cases)} ELSE (({rest}) // 60) || 'min ' || (({rest}) % 60) || 'sec' END"


@query(f"SELECT event_id, {_duration_sql()} AS text FROM (SELECT event_id, event_id * event_id * 37 % 90000000 // (1 + event_id % 5 * 1000) AS s FROM events)")
def format_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("event_id * event_id * 37 % 90000000 div (1 + event_id % 5 * 1000)")
    return table(spark, sf_dir, "events").select("event_id", formats.format_duration(s).alias("text"))


@query("SELECT user_id, max(ts) - min(ts) AS experience, max(gap)::BIGINT AS max_gap FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts), 0) AS gap FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS ts FROM events)) GROUP BY user_id")
def event_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    times = table(spark, sf_dir, "events").select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts"))
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")), F.lit(0))
    return times.withColumn("gap", gap).groupBy("user_id").agg((F.max("ts") - F.min("ts")).alias("experience"), F.max("gap").alias("max_gap"))


# Metadata, languages, sinks


@of_history(
    "SELECT project_id, (j->>'stargazers_count')::BIGINT AS stargazers_count, (j->>'fork')::BOOLEAN AS fork, CASE lower(j->>'language') WHEN 'c++' THEN 'Cpp' WHEN 'python' THEN 'Python' WHEN 'perl 6' THEN 'Perl' WHEN 'rust' THEN 'Rust' END AS language, j->'license'->>'name' AS license,"
    " epoch((j->>'created_at')::TIMESTAMP)::BIGINT AS created, CASE WHEN (j->>'issues_count') IS NULL AND (j->>'buggy_issues_count') IS NULL THEN NULL ELSE coalesce((j->>'issues_count')::BIGINT, 0) + coalesce((j->>'buggy_issues_count')::BIGINT, 0) END AS all_issues FROM (SELECT project_id, json::JSON AS j FROM project_metadata)"
)
def project_metadata(h: History) -> DataFrame:
    none = F.col("issues_count").isNull() & F.col("buggy_issues_count").isNull()
    both = F.when(~none, F.coalesce("issues_count", F.lit(0)) + F.coalesce("buggy_issues_count", F.lit(0)))
    return h.metadata.select("project_id", "stargazers_count", "fork", language_of_name(F.col("language")).alias("language"), "license", "created", both.alias("all_issues"))


@of_history("SELECT path_id, CASE regexp_extract(location, '(^|/)[^/]+[.]([^./]*)$', 2) WHEN 'py' THEN 'Python' WHEN 'c' THEN 'C' WHEN 'C' THEN 'C++' WHEN 'rs' THEN 'Rust' WHEN 'js' THEN 'JavaScript' WHEN 'zzz' THEN 'Other' END AS language FROM paths")
def path_language(h: History) -> DataFrame:
    return h.paths.select("path_id", display_name(language_of_path(F.col("location"))).alias("language"))


@query("SELECT doc_id, lang, source, text FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read again."""
    return round_trip_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


# Graphs and metrics


@of_history("SELECT project_id, commit_id FROM pc")
def project_commits(h: History) -> DataFrame:
    return h.project_commits


@of_history("SELECT * FROM (WITH RECURSIVE m AS (SELECT project_id, commit_id FROM project_heads JOIN (SELECT project_id, 'refs/heads/' || (json::JSON->>'default_branch') AS branch FROM project_metadata) USING (project_id) WHERE name = branch UNION SELECT m.project_id, p.parent_id FROM m JOIN commit_parents p ON p.commit_id = m.commit_id) SELECT project_id, count(*) AS n FROM m GROUP BY project_id)")
def main_branch_commits(h: History) -> DataFrame:
    return h.main_branch_commits(h.metadata.select("project_id", "default_branch")).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@of_history("SELECT * FROM (WITH RECURSIVE a AS (SELECT commit_id AS seed, commit_id AS node FROM project_heads UNION SELECT a.seed, p.parent_id FROM a JOIN commit_parents p ON p.commit_id = a.node) SELECT seed AS commit_id, count(*) AS preceding FROM a GROUP BY seed)")
def preceding_commits(h: History) -> DataFrame:
    """Of each head's commit: its ancestors with itself."""
    return entities.preceding_counts(h, h.project_heads).withColumnRenamed("of", "commit_id")


#: Of the changes of a path that a head reaches, one without a change that descends from it: of several the one whose ancestors
#: go to the latest time, then the one with the greatest id.
_TREE = """(WITH RECURSIVE a AS (SELECT DISTINCT commit_id AS seed, commit_id AS node FROM (SELECT commit_id FROM project_heads UNION SELECT commit_id FROM commit_changes) UNION SELECT a.seed, p.parent_id FROM a JOIN commit_parents p ON p.commit_id = a.node),
    d AS (SELECT a.seed AS node, max(committer_time) AS latest FROM a JOIN commits c ON c.commit_id = a.node GROUP BY a.seed),
    k AS (SELECT a.seed, path_id, a.node, snapshot_id FROM a JOIN commit_changes ON commit_id = a.node WHERE a.seed IN (SELECT commit_id FROM project_heads)),
    lost AS (SELECT DISTINCT x.seed, x.path_id, x.node FROM k x JOIN k y ON x.seed = y.seed AND x.path_id = y.path_id AND x.node <> y.node JOIN a ON a.seed = y.node AND a.node = x.node)
    SELECT seed, path_id, snapshot_id FROM k ANTI JOIN lost USING (seed, path_id, node) LEFT JOIN d USING (node) QUALIFY row_number() OVER (PARTITION BY seed, path_id ORDER BY latest DESC NULLS LAST, node DESC) = 1)"""


@of_history(f"SELECT seed AS commit_id, path_id, snapshot_id FROM {_TREE}")
def commit_trees(h: History) -> DataFrame:
    """The tree of each head's commit, with deletions."""
    return metrics.commit_trees(h, h.project_heads, deletions=True)


@of_history(f"SELECT project_id, name, path_id, snapshot_id FROM {_TREE} JOIN project_heads ON commit_id = seed WHERE snapshot_id IS NOT NULL")
def head_trees(h: History) -> DataFrame:
    return metrics.head_trees(h)


@of_history(f"SELECT project_id, sum(length(contents) - length(replace(contents, chr(10), '')))::BIGINT AS locs FROM {_TREE} JOIN project_heads ON commit_id = seed JOIN snapshots USING (snapshot_id) JOIN (SELECT project_id, 'refs/heads/' || (json::JSON->>'default_branch') AS branch FROM project_metadata) USING (project_id) WHERE name = branch GROUP BY project_id")
def project_locs(h: History) -> DataFrame:
    return metrics.project_locs(h)


_DEFAULT = "(SELECT project_id, name, commit_id FROM project_heads JOIN (SELECT project_id, 'refs/heads/' || (json::JSON->>'default_branch') AS branch FROM project_metadata) USING (project_id) WHERE name = branch)"


@of_history(f"SELECT project_id, name, commit_id FROM {_DEFAULT}")
def default_heads(h: History) -> DataFrame:
    return metrics.default_heads(h)


@of_history(f"SELECT project_id, hash, author_id, committer_time FROM {_DEFAULT} JOIN commits USING (commit_id)")
def default_commits(h: History) -> DataFrame:
    return metrics.default_commits(h).select("project_id", "hash", "author_id", "committer_time")


@of_history(f"SELECT project_id, path_id, snapshot_id FROM {_TREE} JOIN {_DEFAULT} ON commit_id = seed WHERE snapshot_id IS NOT NULL")
def default_trees(h: History) -> DataFrame:
    return metrics.default_trees(h).select("project_id", "path_id", "snapshot_id")


@of_history("SELECT project_id, time, is_error FROM project_logs WHERE project_id IN (SELECT project_id FROM projects WHERE substore = 'small') AND time <= 800000000")
def substore_logs(h: History) -> DataFrame:
    """The logs of one substore's projects up to a time."""
    return h.of_substores(["small"]).at(800_000_000).project_logs


@of_history(
    "SELECT project_id, count(*) AS commits FROM pc JOIN commits USING (commit_id) WHERE committer_time <= 800000000 AND project_id IN (SELECT project_id FROM projects WHERE substore = 'small') GROUP BY project_id"
)
def substore_commits_at(h: History) -> DataFrame:
    """Commits of one substore's projects, as of a time. Here commits are never older than their parents by over seven hours."""
    return h.of_substores(["small"]).at(800_000_000).full_commits.groupBy("project_id").agg(F.count(F.lit(1)).alias("commits"))


@of_history("SELECT project_id, max(greatest(author_time, committer_time)) - min(least(author_time, committer_time)) AS age FROM pcc GROUP BY project_id")
def project_age(h: History) -> DataFrame:
    return metrics.ages(h)


_GAPS = "SELECT project_id, coalesce(max(gap), 0)::BIGINT AS max_gap, coalesce(round((max(t) - min(t)) / nullif(count(*) - 1, 0)), 0)::BIGINT AS mean_gap, min(t) AS first, max(t) AS last FROM (SELECT project_id, committer_time AS t, committer_time - lag(committer_time) OVER (PARTITION BY project_id ORDER BY committer_time) AS gap FROM pcc) GROUP BY project_id"
_STATE = "SELECT project_id, CASE WHEN valid THEN t ELSE -1 END AS latest_update, valid AS is_valid FROM (SELECT project_id, time AS t, NOT is_error AS valid, row_number() OVER (PARTITION BY project_id ORDER BY time DESC, (NOT is_error) DESC) AS k FROM project_logs) WHERE k = 1"


@of_history(f"SELECT project_id, max_gap, mean_gap FROM ({_GAPS})")
def commit_gaps(h: History) -> DataFrame:
    return metrics.commit_gaps(h)


@of_history(_STATE)
def update_state(h: History) -> DataFrame:
    return metrics.update_state(h)


@of_history(f"SELECT project_id, CASE WHEN latest_update > 0 THEN latest_update - first ELSE 0 END AS since_first, CASE WHEN latest_update > 0 THEN latest_update - last ELSE 0 END AS since_last, (CASE WHEN latest_update > 0 THEN latest_update - last ELSE 0 END) > max_gap AS is_abandoned FROM ({_GAPS}) JOIN ({_STATE}) USING (project_id)")
def project_activity(h: History) -> DataFrame:
    return metrics.activity(h)


@of_history("SELECT project_id, arg_min(commit_id, (committer_time, commit_id)) AS oldest, arg_max(commit_id, (committer_time, commit_id)) AS newest FROM pcc GROUP BY project_id")
def oldest_newest_commit(h: History) -> DataFrame:
    return metrics.end_commits(h)


@of_history("SELECT project_id, count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS authors, count(DISTINCT committer_id) AS committers, (SELECT count(DISTINCT u) FROM (SELECT author_id AS u FROM pcc b WHERE b.project_id = a.project_id UNION SELECT committer_id FROM pcc b WHERE b.project_id = a.project_id)) AS users FROM pcc a GROUP BY project_id")
def project_counts(h: History) -> DataFrame:
    return metrics.counts(h)


@of_history("SELECT project_id, count(DISTINCT path_id) AS paths, count(DISTINCT s.snapshot_id) AS snapshots FROM pch LEFT JOIN snapshots s ON s.snapshot_id = pch.snapshot_id GROUP BY project_id")
def project_contents(h: History) -> DataFrame:
    return metrics.content_counts(h)


_CONTRIB = "SELECT project_id, author_id, n, row_number() OVER w AS place, floor(100 * sum(n) OVER w / sum(n) OVER (PARTITION BY project_id))::BIGINT AS percent, sum(n) OVER w AS running, sum(n) OVER (PARTITION BY project_id) AS whole FROM (SELECT project_id, author_id, count(*) AS n FROM {} WHERE author_id IS NOT NULL GROUP BY project_id, author_id) WINDOW w AS (PARTITION BY project_id ORDER BY n DESC, author_id ROWS UNBOUNDED PRECEDING)"
_BY_COMMIT, _BY_CHANGE = _CONTRIB.format("pcc"), _CONTRIB.format("(SELECT pcc.* FROM pcc JOIN commit_changes USING (commit_id))")


def _contributed(name: str, of: str, sql: str) -> None:
    QUERIES[f"{name}_contributions"] = lambda spark, sf_dir: metrics.contributions(history(spark, sf_dir), of).select("project_id", "author_id", "n", F.col("place").cast("long").alias("place"), "percent")
    SQL[f"{name}_contributions"] = f"{PRELUDE} SELECT project_id, author_id, n, place, percent FROM ({sql})"
    for p in (50, 80, 95):
        QUERIES[f"authors_of_{p}_percent_{name}s"] = lambda spark, sf_dir, p=p: metrics.main_contributors(history(spark, sf_dir), p, of)
        SQL[f"authors_of_{p}_percent_{name}s"] = f"{PRELUDE} SELECT project_id, author_id FROM ({sql}) WHERE running - n < floor({p} * whole / 100) OR place = 1"


_contributed("commit", "commits", _BY_COMMIT)
_contributed("change", "changes", _BY_CHANGE)


@of_history(
    "SELECT user_id, author_experience, committer_experience, greatest(last, cl) - least(first, cf) AS experience, first, last, coalesce(authored, 0) AS authored, coalesce(committed, 0) AS committed"
    " FROM (SELECT author_id AS user_id, max(author_time) - min(author_time) AS author_experience, min(author_time) AS first, max(author_time) AS last, count(*) AS authored FROM commits WHERE author_id IS NOT NULL GROUP BY author_id)"
    " FULL JOIN (SELECT committer_id AS user_id, max(committer_time) - min(committer_time) AS committer_experience, min(committer_time) AS cf, max(committer_time) AS cl, count(*) AS committed FROM commits WHERE committer_id IS NOT NULL GROUP BY committer_id) USING (user_id)"
)
def user_times(h: History) -> DataFrame:
    return metrics.user_times(h)


_OWN = "SELECT author_id AS user_id, project_id, count(DISTINCT commit_id) AS k, least(count(DISTINCT commit_id), any_value(users)) AS j FROM pcc JOIN (SELECT project_id, count(DISTINCT u) AS users FROM (SELECT project_id, unnest([author_id, committer_id]) AS u FROM pcc) GROUP BY project_id) USING (project_id) WHERE author_id IS NOT NULL GROUP BY author_id, project_id"
_H = "SELECT user_id, count(*) FILTER (k >= a - {o}) AS h_index1, count(*) FILTER (j >= b - {o}) AS h_index2 FROM (SELECT user_id, k, j, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS a, row_number() OVER (PARTITION BY user_id ORDER BY j DESC) AS b FROM (" + _OWN + ")) GROUP BY user_id"
_DEV = "SELECT user_id, count(*) FILTER (k >= r) AS developer_experience FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM (SELECT author_id AS user_id, (author_time - first) // 2592000 AS month, count(*) AS k FROM (SELECT author_id, author_time, min(author_time) OVER (PARTITION BY author_id) AS first FROM commits WHERE author_id IS NOT NULL) GROUP BY 1, 2)) GROUP BY user_id"


@of_history(_H.format(o=0))
def user_h_indices(h: History) -> DataFrame:
    return metrics.h_indices(h)


@of_history(_H.format(o=1))
def user_h_indices_from_zero(h: History) -> DataFrame:
    return metrics.h_indices(h, compat=True)


@of_history(f"SELECT user_id, least(h.developer_experience + 1, months) AS developer_experience FROM ({_DEV.replace('2592000', '2592001')}) h JOIN (SELECT user_id, count(DISTINCT (author_time - first) // 2592001) AS months FROM (SELECT author_id AS user_id, author_time, min(author_time) OVER (PARTITION BY author_id) AS first FROM commits WHERE author_id IS NOT NULL) GROUP BY user_id) USING (user_id)")
def developer_experience_compat(h: History) -> DataFrame:
    return metrics.developer_experience(h, compat=True)


@of_history("SELECT project_id, coalesce(max(gap), 0) AS max_gap, (CASE WHEN count(*) > 2 THEN round(max(committer_time) / (count(*) - 1)) ELSE max(committer_time) END)::BIGINT AS mean_gap FROM (SELECT project_id, committer_time, committer_time - lag(committer_time) OVER (PARTITION BY project_id ORDER BY committer_time) AS gap FROM pcc WHERE committer_time IS NOT NULL) GROUP BY project_id")
def commit_gaps_compat(h: History) -> DataFrame:
    return metrics.commit_gaps(h, compat=True)


@of_history(_DEV)
def developer_experience(h: History) -> DataFrame:
    return metrics.developer_experience(h)


@of_history(f"SELECT project_id, sum(n * developer_experience) / sum(n) AS mean_experience, max(developer_experience) AS max_experience, max(lifetime) AS max_lifetime, max(h_index1) AS max_h_index1, max(h_index2) AS max_h_index2 FROM (SELECT project_id, author_id AS user_id, count(*) AS n FROM pcc WHERE author_id IS NOT NULL GROUP BY project_id, author_id) JOIN ({_DEV}) USING (user_id) JOIN (SELECT author_id AS user_id, max(author_time) - min(author_time) AS lifetime FROM commits WHERE author_id IS NOT NULL GROUP BY author_id) USING (user_id) JOIN ({_H.format(o=0)}) USING (user_id) GROUP BY project_id")
def project_experience(h: History) -> DataFrame:
    return metrics.project_experience(h)


@of_history("SELECT DISTINCT author_id AS user_id, project_id FROM pcc WHERE author_id IS NOT NULL")
def user_projects(h: History) -> DataFrame:
    return metrics.user_projects(h)


_PATHS = "SELECT path_id, CASE p_size % 7 WHEN 0 THEN 'Python' WHEN 1 THEN 'C' WHEN 2 THEN 'Cpp' WHEN 3 THEN 'Other' WHEN 5 THEN 'Rust' WHEN 6 THEN 'JavaScript' END AS language, CASE p_size % 7 WHEN 0 THEN 31 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 43 WHEN 5 THEN 36 WHEN 6 THEN 23 END AS o FROM paths JOIN part ON p_partkey = path_id"
_COMP = f"SELECT project_id, language, n, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, o) AS place FROM (SELECT project_id, language, o, count(*) AS n FROM pch JOIN ({_PATHS}) USING (path_id) WHERE language IS NOT NULL GROUP BY project_id, language, o)"


@of_history(_COMP)
def language_composition(h: History) -> DataFrame:
    return metrics.language_composition(h).withColumn("place", F.col("place").cast("long"))


@of_history(f"SELECT project_id, arg_min(language, place) AS language, max(n) AS changes, max(n) / sum(n) AS share FROM ({_COMP}) GROUP BY project_id")
def major_language(h: History) -> DataFrame:
    return metrics.major_language(h)


@of_history(f"SELECT DISTINCT commit_id, language FROM commit_changes JOIN ({_PATHS}) USING (path_id) WHERE language IS NOT NULL")
def commit_languages(h: History) -> DataFrame:
    return metrics.commit_languages(h)


_ORIGIN = "SELECT snapshot_id, count(*) AS copies, arg_min(project_id, (created IS NULL, coalesce(created, 0), first, project_id)) AS original FROM (SELECT snapshot_id, project_id, min(author_time) AS first FROM pch JOIN commits USING (commit_id) WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id, project_id) JOIN projects USING (project_id) GROUP BY snapshot_id"


@of_history(_ORIGIN)
def snapshot_origins(h: History) -> DataFrame:
    return metrics.snapshot_origins(h)


@of_history(f"SELECT project_id, count(*) FILTER (copies = 1) AS unique_files, count(*) FILTER (original = project_id AND copies > 1) AS original_files, sum(CASE WHEN original = project_id THEN copies ELSE 0 END)::BIGINT AS impact, floor(100 * count(*) FILTER (original <> project_id) / count(*))::BIGINT AS duplicated_code FROM (SELECT DISTINCT project_id, snapshot_id FROM pch WHERE snapshot_id IN (SELECT snapshot_id FROM snapshots)) JOIN ({_ORIGIN}) USING (snapshot_id) GROUP BY project_id")
def project_originality(h: History) -> DataFrame:
    return metrics.originality(h)


_DATED = "SELECT pc.project_id, pc.commit_id, created FROM pc JOIN projects USING (project_id) WHERE created IS NOT NULL"


@of_history(f"SELECT DISTINCT a.project_id, b.project_id AS fork_id FROM ({_DATED}) a JOIN ({_DATED}) b ON a.commit_id = b.commit_id AND (b.created > a.created OR (b.created = a.created AND b.project_id > a.project_id))")
def project_forks(h: History) -> DataFrame:
    return metrics.forks(h)


_FAMILIES = "(SELECT commit_id AS root_id, project_id, row_number() OVER (PARTITION BY commit_id ORDER BY created, project_id) AS place, count(*) OVER (PARTITION BY commit_id) AS members FROM pc JOIN projects USING (project_id) WHERE created IS NOT NULL AND commit_id NOT IN (SELECT commit_id FROM commit_parents))"


@of_history(f"SELECT root_id, project_id, place, members FROM {_FAMILIES}")
def fork_families(h: History) -> DataFrame:
    return metrics.fork_families(h)


@of_history(f"SELECT a.project_id, count(DISTINCT b.project_id) AS forks FROM {_FAMILIES} a LEFT JOIN {_FAMILIES} b ON a.root_id = b.root_id AND b.place > a.place GROUP BY a.project_id")
def fork_counts(h: History) -> DataFrame:
    return metrics.fork_counts(h)


@of_history("SELECT project_id, len(v)::BIGINT AS n, v[(len(v) + 1) // 2]::BIGINT AS low, v[len(v) // 2 + 1]::BIGINT AS high FROM (SELECT project_id, list(strlen(message) * (commit_id % 11) ORDER BY strlen(message) * (commit_id % 11)) AS v FROM pcc GROUP BY project_id)")
def project_medians(h: History) -> DataFrame:
    """How many figures of commits each project has, and the middle ones."""
    return order_statistics(h.full_commits.select("project_id", (statistics.length(F.col("message")) * (F.col("commit_id") % 11)).alias("v")), ["project_id"], "v")


@of_history("SELECT commit_id, count(*) AS projects FROM pc GROUP BY commit_id")
def commit_projects(h: History) -> DataFrame:
    return metrics.commit_projects(h)


@of_history("SELECT commit_id, strlen(message)::BIGINT AS message_length, coalesce(changes, 0) AS changes, coalesce(deletions, 0) AS deletions, coalesce(parents, 0) AS parents FROM commits LEFT JOIN (SELECT commit_id, count(*) AS changes, count(*) FILTER (snapshot_id IS NULL) AS deletions FROM commit_changes GROUP BY commit_id) USING (commit_id) LEFT JOIN (SELECT commit_id, count(*) AS parents FROM commit_parents GROUP BY commit_id) USING (commit_id)")
def commit_figures(h: History) -> DataFrame:
    changes = h.commit_changes.groupBy("commit_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("snapshot_id").isNull()).alias("deletions"))
    parents = h.commit_parents.groupBy("commit_id").agg(F.count(F.lit(1)).alias("parents"))
    joined = h.commits.join(changes, "commit_id", "left").join(parents, "commit_id", "left")
    return joined.select("commit_id", statistics.length(F.col("message")).alias("message_length"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("changes", "deletions", "parents")])


# Layouts

_COUNTS = "SELECT project_id, count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS authors, count(DISTINCT committer_id) AS committers, count(DISTINCT u) AS users FROM (SELECT *, unnest([author_id, committer_id]) AS u FROM pcc) GROUP BY project_id"
_AGE = "SELECT project_id, max(greatest(author_time, committer_time)) - min(least(author_time, committer_time)) AS lifetime FROM pcc GROUP BY project_id"
_FIELDS = {"is_archived": ("archived", "BOOLEAN"), "is_disabled": ("disabled", "BOOLEAN"), **{f"has_{c}": (f"has_{c}", "BOOLEAN") for c in ("issues", "downloads", "wiki", "pages")}}
_FIELDS |= {"watchers": ("watchers_count", "BIGINT"), "size": ("size", "BIGINT"), "open_issues": ("open_issues_count", "BIGINT"), "forks": ("forks", "BIGINT"), "subscribers": ("subscribers_count", "BIGINT")}
_FIELDS |= {c: (c, "VARCHAR") for c in ("homepage", "description", "default_branch")}
_METADATA = ", ".join(f"(j->>'{f}')::{t} AS {c}" for c, (f, t) in _FIELDS.items()) + ", epoch((j->>'updated_at')::TIMESTAMP)::BIGINT AS updated, epoch((j->>'pushed_at')::TIMESTAMP)::BIGINT AS pushed"


@of_history(
    "SELECT p.project_id, substore, url, (j->>'fork')::BOOLEAN AS is_fork, (j->>'stargazers_count')::BIGINT AS stars, (j->>'issues_count')::BIGINT AS issues, (j->>'buggy_issues_count')::BIGINT AS buggy_issues,"
    " CASE WHEN (j->>'issues_count') IS NULL AND (j->>'buggy_issues_count') IS NULL THEN NULL ELSE coalesce((j->>'issues_count')::BIGINT, 0) + coalesce((j->>'buggy_issues_count')::BIGINT, 0) END AS all_issues,"
    " CASE lower(j->>'language') WHEN 'c++' THEN 'Cpp' WHEN 'python' THEN 'Python' WHEN 'perl 6' THEN 'Perl' WHEN 'rust' THEN 'Rust' END AS language, lifetime, epoch((j->>'created_at')::TIMESTAMP)::BIGINT AS created, j->'license'->>'name' AS license,"
    f" {_METADATA}, heads, commits, authors, committers, users FROM projects p LEFT JOIN (SELECT project_id, json::JSON AS j FROM project_metadata) USING (project_id) LEFT JOIN ({_AGE}) USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS heads FROM project_heads GROUP BY project_id) USING (project_id) LEFT JOIN ({_COUNTS}) USING (project_id)"
)
def project_layout(h: History) -> DataFrame:
    return project_rows(h)


def _sql_of(name: str, *columns: str) -> str:
    """The named query's SQL as a table of project_id and these columns (given as "column AS name")."""
    return f"(SELECT project_id, {', '.join(columns)} FROM ({SQL[name].removeprefix(PRELUDE)}))"


def _cutoff(percent: int, of: str) -> str:
    return f"(SELECT project_id, count(*) AS \"authors_contributing_{percent}%_{of}s\" FROM ({SQL[f'authors_of_{percent}_percent_{of}s'].removeprefix(PRELUDE)}) GROUP BY project_id)"


_EXTENDED = [
    _sql_of("project_contents", "paths", "snapshots", "paths AS files"), _sql_of("project_originality", "unique_files", "original_files", "impact", "duplicated_code"),
    _sql_of("major_language", "language AS major_language", "share AS major_language_ratio", "changes AS major_language_changes"),
    f"(SELECT project_id, count(*) AS all_forks_count FROM ({SQL['project_forks'].removeprefix(PRELUDE)}) GROUP BY project_id)",
    _sql_of("commit_gaps", "max_gap AS max_commit_delta", "mean_gap AS avg_commit_delta"), _sql_of("project_activity", "since_first AS first_commit", "since_last AS last_commit", "is_abandoned"),
    _sql_of("project_locs", "locs"), _sql_of("update_state", "is_valid"), _sql_of("project_experience", "max_experience", "mean_experience AS project_experience"),
    *[_cutoff(p, of) for of in ("commit", "change") for p in (95, 80, 50)],
]


@of_history(f"SELECT * FROM ({SQL['project_layout'].removeprefix(PRELUDE)}) " + " ".join(f"LEFT JOIN {t} USING (project_id)" for t in _EXTENDED))
def project_layout_extended(h: History) -> DataFrame:
    """All figures of a project in one row."""
    return project_rows(h, extended=True)


@of_history("SELECT user_id, email, coalesce(authored, 0) AS authored_commits, coalesce(committed, 0) AS committed_commits, author_experience, committer_experience, greatest(last, cl) - least(first, cf) AS experience FROM users LEFT JOIN (SELECT author_id AS user_id, max(author_time) - min(author_time) AS author_experience, min(author_time) AS first, max(author_time) AS last, count(*) AS authored FROM commits GROUP BY author_id) USING (user_id) LEFT JOIN (SELECT committer_id AS user_id, max(committer_time) - min(committer_time) AS committer_experience, min(committer_time) AS cf, max(committer_time) AS cl, count(*) AS committed FROM commits GROUP BY committer_id) USING (user_id)")
def user_layout(h: History) -> DataFrame:
    return user_rows(h)


@of_history("SELECT commit_id, hash, committer_id, author_id, coalesce(parent_ids, '') AS parent_ids, coalesce(parent_count, 0) AS parent_count, author_time AS author_timestamp, committer_time AS committer_timestamp, coalesce(changed_paths, '') AS changed_paths, coalesce(changed_path_count, 0) AS changed_path_count, message, strlen(message)::BIGINT AS message_length FROM commits LEFT JOIN (SELECT commit_id, string_agg(parent_id, ' ' ORDER BY pos) AS parent_ids, count(*) AS parent_count FROM commit_parents GROUP BY commit_id) USING (commit_id) LEFT JOIN (SELECT commit_id, string_agg(path_id, ' ' ORDER BY path_id) AS changed_paths, count(*) AS changed_path_count FROM commit_changes GROUP BY commit_id) USING (commit_id)")
def commit_layout(h: History) -> DataFrame:
    rows = commit_rows(h, extended=True)
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("parent_ids", "changed_paths")})


@of_history("SELECT path_id, location AS path, CASE regexp_extract(location, '(^|/)[^/]+[.]([^./]*)$', 2) WHEN 'py' THEN 'Python' WHEN 'c' THEN 'C' WHEN 'C' THEN 'Cpp' WHEN 'rs' THEN 'Rust' WHEN 'js' THEN 'JavaScript' WHEN 'zzz' THEN 'Other' END AS language FROM paths")
def path_layout(h: History) -> DataFrame:
    return path_rows(h)


@of_history("SELECT snapshot_id, contents AS content FROM snapshots")
def snapshot_layout(h: History) -> DataFrame:
    return snapshot_rows(h)


@of_history(f"SELECT seed AS commit_id, hash AS commit_hash, path_id, location AS path, snapshot_id FROM {_TREE} JOIN commits ON commit_id = seed JOIN paths USING (path_id)")
def tree_layout(h: History) -> DataFrame:
    return tree_rows(h, h.project_heads, deletions=True).drop("language")


# Stores, lookups, groups without rows, and what snapshots hold


def _renumbered(h: History, shift: int) -> History:
    """The same store with other numbers: those of this one mean other entities there."""
    columns = ("project_id", "commit_id", "parent_id", "author_id", "committer_id", "user_id", "path_id", "snapshot_id")
    return History({name: df.withColumns({c: F.col(c) * 2 + shift for c in columns if c in df.columns}) for name, df in h.tables.items()})


@of_history("SELECT url, count(DISTINCT pcc.commit_id) AS commits, count(DISTINCT email) AS authors, count(DISTINCT location) AS paths FROM projects LEFT JOIN pcc USING (project_id) LEFT JOIN users ON user_id = author_id LEFT JOIN commit_changes ch ON ch.commit_id = pcc.commit_id LEFT JOIN paths USING (path_id) GROUP BY url")
def merged_stores(h: History) -> DataFrame:
    """Two substores kept as separate stores, whose numbers clash, merged again: figures of each project by names, not numbers."""
    one, other = h.of_substores(["small"]), _renumbered(h.of_substores(["generic"]), 1)
    m = merged([one, other])
    # Projects of one URL are one; those without any count together. Figures are taken by number, URLs join them at the end.
    owner = F.when(F.col("url").isNull(), 0).otherwise(F.col("project_id")).cast("long").alias("owner")
    projects = materialized(m.columns("projects", "project_id", "url").select("project_id", "url", owner))
    commits = m.project_commits.join(m.columns("commits", "commit_id", "author_id"), "commit_id").join(projects.select("project_id", "owner"), "project_id")
    commits = materialized(commits.select("owner", "commit_id", "author_id"))
    each = commits.groupBy("owner").agg(F.count_distinct("commit_id").alias("commits"), F.count_distinct("author_id").alias("authors"))
    # Paths apart: counted with the others, each change would be one row for every figure.
    changed = commits.select("owner", "commit_id").join(m.columns("commit_changes", "commit_id", "path_id"), "commit_id").where("path_id IS NOT NULL").select("owner", "path_id").distinct()
    paths = changed.groupBy("owner").agg(F.count(F.lit(1)).alias("paths"))
    rows = projects.select("owner", "url").distinct().join(each, "owner", "left").join(paths, "owner", "left")
    return rows.select("url", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("commits", "authors", "paths")])


@of_history("SELECT 'project' AS kind, url AS what FROM projects WHERE project_id = 17 UNION ALL SELECT 'commit', hash FROM commits WHERE commit_id = 33 UNION ALL SELECT 'user', email FROM users WHERE user_id = 5 UNION ALL SELECT 'path', location FROM paths WHERE path_id = 1000000000 UNION ALL SELECT 'path', location FROM paths WHERE path_id = 40 UNION ALL SELECT 'hash', message FROM commits WHERE hash = md5('33')")
def point_lookups(h: History) -> DataFrame:
    """Single entities from the tables written by id."""
    spark = h.projects.sparkSession
    path = shared_path(spark)
    write_by_id(h, path, ids_per_block=500)
    found = ById.at_path(spark, path, ids_per_block=500)
    parts = [found.by_id(table, id).select(F.lit(table[:-1]).alias("kind"), F.col(c).alias("what")) for table, id, c in (("projects", 17, "url"), ("commits", 33, "hash"), ("users", 5, "email"), ("paths", 10**9, "location"), ("paths", 40, "location"))]
    parts.append(found.by_hash(hashlib.md5(b"33").hexdigest()).select(F.lit("hash").alias("kind"), F.col("message").alias("what")))
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT segment, count(c_custkey) FILTER (n_orders >= 24) AS projects, max(n_orders) FILTER (n_orders >= 24) AS most FROM (SELECT *, c_mktsegment || '-' || c_nationkey AS segment FROM ({_CUSTOMERS})) GROUP BY segment")
def groups_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language and nation, how many projects have 24 commits or more; most groups are left without any, and stay."""
    grouped = _customers(spark, sf_dir).group_by(segment=F.concat_ws("-", "c_mktsegment", "c_nationkey")).filter_by(predicates.at_least(F.col("n_orders"), 24, missing=False))
    return grouped.per_group(projects=F.count(F.lit(1)), most=F.max("n_orders"))


@of_history("SELECT commit_id, path_id, CASE WHEN ch.snapshot_id IS NOT NULL THEN s.contents IS NOT NULL END AS has_contents FROM commit_changes ch LEFT JOIN snapshots s ON s.snapshot_id = ch.snapshot_id")
def changes_have_contents(h: History) -> DataFrame:
    return entities.with_contents(h, h.commit_changes).select("commit_id", "path_id", "has_contents")


@of_history("SELECT snapshot_id, strlen(contents)::BIGINT AS bytes, md5(contents) AS hash FROM snapshots")
def snapshot_bytes(h: History) -> DataFrame:
    """Contents as bytes."""
    b = F.col("contents").cast("binary")
    return h.snapshots.select("snapshot_id", F.octet_length(b).cast("long").alias("bytes"), F.md5(b).alias("hash"))


@of_history(f"SELECT DISTINCT seed AS commit_id, snapshot_id FROM {_TREE} WHERE snapshot_id IS NOT NULL")
def tree_snapshots(h: History) -> DataFrame:
    """The different snapshots of each head's tree."""
    return entities.tree_snapshots(metrics.commit_trees(h, h.project_heads), "commit_id")


@of_history("SELECT seed AS commit_id, path_id, md5(contents) AS contents FROM " + _TREE + " JOIN snapshots USING (snapshot_id)")
def tree_snapshots_with_data(h: History) -> DataFrame:
    """The files of each head's tree with their contents."""
    return entities.snapshots_of(h, metrics.commit_trees(h, h.project_heads), contents=F.md5("contents")).select("commit_id", "path_id", "contents")


@of_history("SELECT project_id, name, h.commit_id, message FROM (SELECT project_id, name, a.node AS commit_id FROM project_heads p JOIN (WITH RECURSIVE a AS (SELECT DISTINCT commit_id AS seed, commit_id AS node FROM project_heads UNION SELECT a.seed, q.parent_id FROM a JOIN commit_parents q ON q.commit_id = a.node) SELECT seed, node FROM a) a ON a.seed = p.commit_id) h JOIN commits c ON c.commit_id = h.commit_id")
def head_commits_with_data(h: History) -> DataFrame:
    """The commits that each head reaches, with their messages."""
    return entities.commits_of(h, entities.head_commits(h)).select("project_id", "name", "commit_id", "message")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 0")
def ids_read_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one selection written as CSV, read again, and kept of another."""
    path = shared_path(spark)
    into_csv(table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name"), path)
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(ids_from_csv(spark, path, "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query(f"SELECT c_custkey, CASE WHEN n_orders IS NULL THEN 'NA' WHEN n_orders > 15 THEN 'large' WHEN n_orders > 8 THEN 'medium' ELSE 'small' END AS stratum FROM ({_CUSTOMERS})")
def exclusive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).rows.select("c_custkey", classify(F.col("n_orders"), [("large", 15), ("medium", 8)], "small", inclusive=False).alias("stratum"))


# Composition


@of_history("SELECT project_id, count(*) FILTER (author_experience >= 63072000) AS experienced, count(*) AS authors FROM (SELECT DISTINCT project_id, author_id FROM pcc WHERE author_id IS NOT NULL) JOIN (SELECT author_id, max(author_time) - min(author_time) AS author_experience FROM commits GROUP BY author_id) USING (author_id) GROUP BY project_id HAVING count(*) >= 2 AND 2 * count(*) FILTER (author_experience >= 63072000) >= count(*)")
def experienced_authors(h: History) -> DataFrame:
    """Projects of two authors or more, at least half of whom have two years of experience."""
    authors = metrics.user_projects(h).join(metrics.user_times(h), "user_id").groupBy("project_id").agg(F.collect_list(F.struct("user_id", "author_experience")).alias("people"))
    chosen = composition.from_each_if(F.col("people"), lambda u: predicates.at_least(u["author_experience"], formats.duration(years=2), missing=False))
    rows = authors.select("project_id", F.size(chosen).cast("long").alias("experienced"), F.size("people").cast("long").alias("authors"))
    return rows.where((F.col("authors") >= 2) & (2 * F.col("experienced") >= F.col("authors")))


@of_history("SELECT commit_id, path_id, ch.snapshot_id FROM commit_changes ch LEFT JOIN snapshots s ON s.snapshot_id = ch.snapshot_id WHERE ch.snapshot_id IS NULL OR s.snapshot_id IS NOT NULL")
def changes_with_contents(h: History) -> DataFrame:
    """Deletions, and changes whose snapshot has stored contents."""
    stored = h.snapshots.select(F.col("snapshot_id").alias("stored"))
    return h.commit_changes.join(stored, F.col("snapshot_id") == F.col("stored"), "left").where("snapshot_id IS NULL OR stored IS NOT NULL").drop("stored")


@of_history("SELECT commit_id, a.email AS author, c.email AS committer FROM commits LEFT JOIN users a ON a.user_id = author_id LEFT JOIN users c ON c.user_id = committer_id")
def commit_people(h: History) -> DataFrame:
    """The author's and the committer's address."""
    person = lambda role: h.users.select(F.col("user_id").alias(f"{role}_of"), F.col("email").alias(role))
    rows = h.commits.join(person("author"), F.col("author_id") == F.col("author_of"), "left").join(person("committer"), F.col("committer_id") == F.col("committer_of"), "left")
    return rows.select("commit_id", "author", "committer")


# The published selections: groups by language, an order, and 50 of each that share at most nine tenths of their commits


def _published(name: str, order: Callable[[History], DataFrame] | None, figure: str, condition: Callable[[History], DataFrame] | None = None, where: str = "true") -> None:
    """figure: SQL of (project_id, figure); where: SQL of the condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = history(spark, sf_dir)
        ids = h.project_commits.groupBy("project_id").agg(F.collect_set("commit_id").alias("commit_ids"))
        rows = h.projects.select("project_id", "url", "segment", "stars").join(ids, "project_id", "left")
        if condition:
            rows = rows.join(condition(h).select("project_id"), "project_id", "left_semi")
        rows = rows.join(order(h).toDF("project_id", "figure"), "project_id", "left") if order else rows.withColumn("figure", F.col("stars"))
        chosen = Selection.of(rows, "project_id").group_by(language=F.col("segment")).sort_by(F.col("figure")).sample(MinRatio(50, "commit_ids", 0.9, "project_id"))
        return chosen.map_into("project_id", "url", "figure")

    QUERIES[f"published_{name}"] = run
    ranked = f"SELECT p.project_id AS id, segment AS g, row_number() OVER (PARTITION BY segment ORDER BY figure DESC NULLS LAST, p.project_id DESC) AS r FROM projects p LEFT JOIN ({figure}) f USING (project_id) WHERE {where}"
    walk = _walk_sql(ranked, "SELECT project_id AS id, commit_id AS x FROM pc", 50, 0.9)
    SQL[f"published_{name}"] = f"{PRELUDE}, {walk} SELECT segment AS language, p.project_id, url, figure FROM walked JOIN projects p ON p.project_id = id LEFT JOIN ({figure}) f USING (project_id)"


def _mean(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(F.avg("v").alias("figure"))


def _median(rows: DataFrame) -> DataFrame:
    return order_statistics(rows, ["project_id"], "v").select("project_id", ((F.col("low") + F.col("high")) / 2).alias("figure"))


def _each(of: str, statistic: Callable[[DataFrame], DataFrame]) -> Callable[[History], DataFrame]:
    def figures(h: History) -> DataFrame:
        paths = h.commit_changes.groupBy("commit_id").agg(F.countDistinct("path_id").alias("paths"))
        rows = h.full_commits.join(paths, "commit_id", "left").select("project_id", (F.coalesce("paths", F.lit(0)) if of == "paths" else statistics.length(F.col("message"))).alias("v"))
        return statistic(rows)

    return figures


_CHANGED_PATHS = "SELECT project_id, {}(coalesce(n, 0)) AS figure FROM pcc LEFT JOIN (SELECT commit_id, count(DISTINCT path_id) AS n FROM commit_changes GROUP BY commit_id) USING (commit_id) GROUP BY project_id"
_MESSAGES = "SELECT project_id, {}(strlen(message)) AS figure FROM pcc GROUP BY project_id"
_N_COMMITS = "SELECT project_id, count(*) AS figure FROM pcc GROUP BY project_id"
_SENIOR = "SELECT user_id FROM (SELECT author_id AS user_id, author_time AS t FROM commits UNION ALL SELECT committer_id, committer_time FROM commits) WHERE user_id IS NOT NULL GROUP BY user_id HAVING max(t) - min(t) >= 63072000"
_WITH_SENIOR = f"p.project_id IN (SELECT project_id FROM pcc WHERE author_id IN ({_SENIOR}))"
_MANY_SENIORS = f"p.project_id IN (SELECT project_id FROM ({SQL['experienced_authors'].removeprefix(PRELUDE)}))"

_published("stars", None, "SELECT project_id, stars AS figure FROM projects")
_published("mean_changed_paths", _each("paths", _mean), _CHANGED_PATHS.format("avg"))
_published("median_changed_paths", _each("paths", _median), _CHANGED_PATHS.format("median"))
_published("experienced_author", lambda h: metrics.counts(h).select("project_id", "commits"), _N_COMMITS, lambda h: metrics.user_projects(h).join(metrics.user_times(h).where("experience >= 63072000"), "user_id"), _WITH_SENIOR)
_published("experienced_authors_ratio", lambda h: metrics.counts(h).select("project_id", F.lit(0)), "SELECT DISTINCT project_id, 0 AS figure FROM pcc", experienced_authors, _MANY_SENIORS)
_published("mean_message_sizes", _each("message", _mean), _MESSAGES.format("avg"))
_published("median_message_sizes", _each("message", _median), _MESSAGES.format("median"))
_published("commits", lambda h: metrics.counts(h).select("project_id", "commits"), _N_COMMITS)
