"""History tables made from the driver's tables, as SQL that Spark and DuckDB both run.

"""

from __future__ import annotations

import re

TABLES = {
    "projects": "SELECT c_custkey AS project_id, c_name AS url, CASE WHEN c_custkey % 4 = 0 THEN 'small' ELSE 'generic' END AS substore, c_mktsegment AS segment, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS stars, CASE WHEN c_custkey % 9 <> 0 THEN 1000000000 + (c_custkey * 7919) % 100000 END AS created FROM customer",
    "project_metadata": """SELECT c_custkey AS project_id, concat('{"stargazers_count": ', CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)) ELSE 'null' END, ', "language": "', CASE c_custkey % 5 WHEN 0 THEN 'C++' WHEN 1 THEN 'python' WHEN 2 THEN 'Perl 6' WHEN 3 THEN 'Klingon' ELSE 'Rust' END, '", "fork": ', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, ', "default_branch": ', CASE WHEN c_custkey % 6 = 0 THEN '"dev"' WHEN c_custkey % 11 = 0 THEN 'null' ELSE '"main"' END, ', "archived": ', CASE WHEN c_custkey % 4 = 1 THEN 'true' ELSE 'false' END, ', "disabled": ', CASE WHEN c_custkey % 5 = 1 THEN 'true' WHEN c_custkey % 5 = 2 THEN 'null' ELSE 'false' END, ', "watchers_count": ', CAST(c_custkey % 101 AS VARCHAR(20)), ', "size": ', CAST(c_custkey * 13 AS VARCHAR(20)), ', "forks": ', CASE WHEN c_custkey % 8 = 0 THEN 'null' ELSE CAST(c_custkey % 17 AS VARCHAR(20)) END, ', "subscribers_count": ', CAST(c_custkey % 23 AS VARCHAR(20)), ', "open_issues_count": ', CAST(c_custkey % 31 AS VARCHAR(20)), ', "description": ', CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE concat('"of ', c_name, '"') END, ', "homepage": ', CASE c_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE concat('"http://', c_name, '"') END, ', "has_issues": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ', "has_downloads": ', CASE WHEN c_custkey % 3 = 1 THEN 'true' ELSE 'false' END, ', "has_wiki": ', CASE WHEN c_custkey % 4 = 2 THEN 'true' ELSE 'false' END, ', "has_pages": ', CASE WHEN c_custkey % 5 = 3 THEN 'true' ELSE 'false' END, ', "updated_at": "2021-0', CAST(1 + c_custkey % 9 AS VARCHAR(20)), '-11T22:33:44Z", "pushed_at": ', CASE WHEN c_custkey % 10 = 0 THEN 'null' ELSE concat('"2021-1', CAST(c_custkey % 3 AS VARCHAR(20)), '-01T00:00:01Z"') END, ', "license": {"name": "', c_mktsegment, '"}, "issues_count": ', CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 50 AS VARCHAR(20)) ELSE 'null' END, ', "buggy_issues_count": ', CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 20 AS VARCHAR(20)) ELSE 'null' END, ', "created_at": "20', CAST(10 + c_custkey % 10 AS VARCHAR(20)), '-03-04T05:06:07Z"}') AS json FROM customer""",
    "project_logs": "SELECT o_custkey AS project_id, EPOCH(o_orderdate) + 2592000 + o_orderkey % 1000 AS time, o_orderstatus = 'F' AS is_error FROM orders",
    "commits": "SELECT o_orderkey AS commit_id, md5(CAST(o_orderkey AS VARCHAR(20))) AS hash, hi AS committer_id, EPOCH(o_orderdate) + 3600 * (o_orderkey % 7) AS committer_time, lo AS author_id, EPOCH(o_orderdate) AS author_time, o_orderpriority AS message FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY l_orderkey) AS a ON l_orderkey = o_orderkey",
    "commit_parents": """SELECT o_orderkey AS commit_id, 0 AS pos, p1 AS parent_id FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p1 FROM orders) AS a WHERE p1 IS NOT NULL
        UNION ALL SELECT o_orderkey AS commit_id, 1 AS pos, p2 AS parent_id FROM (SELECT o_orderkey, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p2 FROM orders) AS b WHERE p2 IS NOT NULL AND o_orderkey % 3 = 0""",
    "project_heads": """SELECT project_id, name, commit_id FROM (
        SELECT o_custkey AS project_id, CASE WHEN k = 1 THEN 'refs/heads/main' ELSE 'refs/heads/dev' END AS name, o_orderkey AS commit_id FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) AS a WHERE k = 1 OR (k = 2 AND o_custkey % 2 = 0)
        UNION ALL SELECT o_custkey + 1 AS project_id, 'refs/heads/fork' AS name, o_orderkey AS commit_id FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) AS b WHERE k = 1 AND (o_custkey + 1) % 10 = 0) AS h""",
    "commit_changes": "SELECT l_orderkey AS commit_id, l_partkey AS path_id, CASE WHEN max(l_returnflag) <> 'R' THEN min((l_partkey + 3 * l_suppkey) % 1500) END AS snapshot_id FROM lineitem GROUP BY l_orderkey, l_partkey",
    "paths": "SELECT p_partkey AS path_id, concat('src/', p_name, CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.c' WHEN 2 THEN '.C' WHEN 3 THEN '.zzz' WHEN 4 THEN '' WHEN 5 THEN '.rs' ELSE '.js' END) AS location FROM part",
    "users": "SELECT s_suppkey AS user_id, s_name AS email FROM supplier",
    "snapshots": "SELECT doc_id AS snapshot_id, text AS contents FROM documents",
}
SOURCES = "customer orders lineitem part supplier documents".split()


def spark_sql(name: str) -> str:
    return re.sub(r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", TABLES[name])


def duckdb_sql(name: str) -> str:
    return re.sub(r"EPOCH\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)", TABLES[name])


#: Common table expressions for DuckDB: the history tables (materialized), the reachable commits of each project, and users.
PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{name} AS MATERIALIZED ({duckdb_sql(name)})" for name in TABLES) + """,
reach AS (SELECT DISTINCT project_id, commit_id FROM project_heads UNION SELECT r.project_id, p.parent_id FROM reach r JOIN commit_parents p ON p.commit_id = r.commit_id),
pc AS MATERIALIZED (SELECT project_id, commit_id FROM reach),
pcc AS MATERIALIZED (SELECT pc.project_id, c.* FROM pc JOIN commits c USING (commit_id)),
pch AS MATERIALIZED (SELECT pc.project_id, ch.* FROM pc JOIN commit_changes ch USING (commit_id))
"""
