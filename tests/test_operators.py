"""Verbs, samplers, reachability, trees and metrics against hand-made cases and plain Python models."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratalog.operators import entities, metrics
from stratalog.operators.blocks import Blocks, join_frequent, order_statistics
from stratalog.operators.graph import chains, closure, latest_times, trees
from stratalog.operators.sampling import Distinct, DistinctRandom, MinRatio, Random, Stratified, Top
from stratalog.operators.selection import Selection, classify, dropped, products, side
from stratalog.sources.files import write_files
from stratalog.sources.history import History
from stratalog.sources.sinks import changes_into_files, dump, flat, into_csv, into_files, round_trip_csv, tree_into_files
from stratalog.sources.stores import ById, entity_ids, merged, write_by_id
from stratalog.sources.tables import Lazy, distinct_of, materialized
from stratalog.sources.timing import Timings


def test_ties_turn_around(spark):
    rows = Selection.of(spark.createDataFrame([(k, 1) for k in range(1, 5)], "id int, v int"), "id")
    assert [r.id for r in rows.sort_by(F.col("v")).ordered().collect()] == [4, 3, 2, 1]
    assert [r.id for r in rows.sort_by(F.col("v"), ascending=True).ordered().collect()] == [1, 2, 3, 4]


def test_products(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], ["a", "b", "c"]), (2, [], ["a"]), (3, None, ["a"])], "id int, x array<int>, y array<string>")
    out = products(rows, "x", "y", keep=("id",)).collect()
    assert len(out) == 10 and [tuple(r) for r in out if r.id == 3] == [(3, None, "a")]


def test_samplers(spark):
    rows = Selection.of(spark.createDataFrame([(k, k % 3 if k % 5 else None, 9_999 + k if k else None) for k in range(20)], "id int, g int, v int"), "id")
    assert [r.id for r in rows.sample(Top(3)).rows.collect()] == [0, 1, 2]
    assert rows.group_by(g=F.col("g")).sample(Top(1)).rows.count() == 4
    first = {r.id for r in rows.sample(Random(5, 42, "id")).rows.collect()}
    assert first == {r.id for r in rows.sample(Random(5, 42, "id")).rows.collect()} and len(first) == 5
    assert sorted(r.id for r in rows.sample(Distinct(Top(9), "g")).rows.collect()) == [0, 1, 2, 3]
    strata = rows.group_by(s=classify(F.col("v"), [("large", 10_000)], "small")).ungroup()
    assert {r.s for r in strata.rows.where("id < 2").collect()} == {"NA", "large"}
    assert strata.sample(Stratified("s", {"large": Top(2)})).rows.count() == 2
    with pytest.raises(ValueError):
        classify(F.lit(1), [("a", 1), ("a", 2)], "b")


@pytest.mark.parametrize("of", ["candidate", "kept"])
def test_min_ratio_against_a_walk(spark, of):
    r = random.Random(4)
    data = [(k, r.choice("ab"), None if r.random() < 0.1 else [r.randrange(8) for _ in range(r.randrange(7))]) for k in range(60)]
    rows = Selection.of(spark.createDataFrame(data, "id int, g string, e array<int>"), "id").group_by(g=F.col("g")).sample(MinRatio(9, "e", 0.5, "id", of))
    want = []
    for g in "ab":
        kept = []
        for k, _, e in (x for x in data if x[1] == g):
            if len(kept) >= 9:
                break
            s = None if e is None else set(e)

            def similar(other, s=s):
                if s is None or other is None:
                    return s is None and other is None
                x = s if of == "candidate" else other
                return bool(x) and len(s & other) / len(x) > 0.5

            if not any(similar(o) for _, o in kept):
                kept.append((k, s))
        want += [k for k, _ in kept]
    assert sorted(x.id for x in rows.rows.collect()) == sorted(want)
    small = Selection.of(spark.createDataFrame(data, "id int, g string, e array<int>"), "id")
    by_blocks = small.group_by(g=F.col("g")).sample(MinRatio(9, "e", 0.5, "id", of, block=4))
    assert sorted(x.id for x in by_blocks.rows.collect()) == sorted(want)
    inner = small.group_by(g=F.col("g")).sample(MinRatio(0, "e", 0.5, "id", of, inner=Top(3), block=7))
    assert sorted(x.id for x in inner.rows.collect()) == sorted(k for g in "ab" for k in [w for w in want if data[w][1] == g][:3])
    assert small.sample(MinRatio(2, "e", 0.5, "id", of)).rows.count() == 2 and small.filter_by(F.lit(False)).sample(MinRatio(2, "e", 0.5, "id", of)).rows.count() == 0


def test_min_ratio_decides_many_rows_in_few_stretches(spark):
    r = random.Random(6)
    families = [r.sample(range(4000), 30) for _ in range(150)]
    data = []
    for k in range(6000):
        base = r.choice(families[: 1 + r.choice([0, 0, 149])])  # one family has more than half of the rows
        data.append((k, [*r.sample(base, r.choice([25, 29, 30])), *r.sample(range(4000, 9000), r.choice([0, 1, 6]))], None))
    df = spark.createDataFrame([(k, e) for k, e, _ in data], "id int, e array<int>")
    for of, block in (("candidate", 100), ("kept", 700)):
        kept = []
        for k, e, _ in data:
            x = set(e)
            if not any(len(x & o) / len(x if of == "candidate" else o) > 0.8 for _, o in kept):
                kept.append((k, x))
        got = Selection.of(df, "id").sample(MinRatio(0, "e", 0.8, "id", of, inner=Top(10**6), block=block)).rows.collect()
        assert sorted(x.id for x in got) == [k for k, _ in kept]
    few = Selection.of(df, "id").sample(MinRatio(40, "e", 0.8, "id", "kept", block=20)).rows.collect()
    assert sorted(x.id for x in few) == [k for k, _ in kept][:40]


def test_distinct_random(spark):
    rows = Selection.of(spark.range(40).selectExpr("id", "cast(id % 5 as string) as g"), "id")
    order = sorted(range(40), key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
    want = [next(k for k in order if k % 5 == g) for g in dict.fromkeys(k % 5 for k in order)][:3]
    assert sorted(r.id for r in rows.sample(DistinctRandom(3, 9, "id", "g")).rows.collect()) == sorted(want)


def test_diamond_dangling_and_deep(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 99)] + [(k, k + 1) for k in range(1000, 1150)]
    found = closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1, 1), (7, 1000), (8, 12345)], "seed long, node long")).collect()
    assert sorted(r.node for r in found if r.seed == 1) == [1, 2, 3, 4, 5, 99]
    assert sorted(r.node for r in found if r.seed == 7) == list(range(1000, 1151))
    assert [r.node for r in found if r.seed == 8] == [12345]


def test_cycle_ends(spark):
    found = closure(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), spark.createDataFrame([(1, 1)], "seed long, node long"))
    assert sorted(r.node for r in found.collect()) == [1, 2]
    edges = [(1, 2), (2, 3), (3, 1), (9, 1), (3, 50), (50, 51), (60, 9)]
    found = closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1, 60), (2, 3), (3, 51)], "seed long, node long"))
    assert sorted((r.seed, r.node) for r in found.collect()) == [(1, n) for n in (1, 2, 3, 9, 50, 51, 60)] + [(2, n) for n in (1, 2, 3, 50, 51)] + [(3, 51)]


def test_tree_deletes(spark):
    graph, heads = chains(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long")), spark.createDataFrame([(3, 3)], "seed long, node long")
    changes = spark.createDataFrame([(1, 10, 100), (2, 10, 101), (3, 10, None), (1, 11, 102)], "commit_id long, path_id long, snapshot_id long")
    assert [(r.path_id, r.snapshot_id) for r in trees(graph, heads, changes).collect()] == [(11, 102)]
    assert sorted((r.path_id, r.snapshot_id) for r in trees(graph, heads, changes, deletions=True).collect() if r.snapshot_id is None) == [(10, None)]


def ancestors(edges):
    up = {}
    for a, b, *_ in edges:
        up.setdefault(a, set()).add(b)
        up.setdefault(b, set())
    out = {}
    for n in sorted(up):  # parents have smaller ids in these tests
        out[n] = {n}.union(*(out[p] for p in up[n]))
    return out


def tree_of(head, known, changes, times):
    """Paths with the last change by ancestry; of several the one with the latest ancestor, then the greatest id."""
    tree = {}
    for path in {p for _, p, _ in changes}:
        mine = [(c, s) for c, p, s in changes if p == path and c in known[head]]
        last = [(max((times[a] for a in known[c] if times.get(a) is not None), default=-1), c, s) for c, s in mine if not any(c != d and c in known[d] for d, _ in mine)]
        if last:
            tree[path] = max(last)[2]
    return tree


def test_reach_and_trees_of_random_histories(spark):
    r = random.Random(3)
    for trial in range(2):
        edges, n = [], 120
        for c in range(2, n + 1):
            parents = {max(1, c - r.choice([1, 1, 1, 2, 5, 30]))} | ({r.randrange(max(1, c - 40), c)} if r.random() < 0.3 else set())
            edges += [(c, p, k) for k, p in enumerate(r.sample(sorted(parents), len(parents))) if r.random() < 0.98]
        edges += [(500, 499, 0)]
        known = ancestors(edges) | {777: {777}}
        times = {c: None if r.random() < 0.1 else r.choice([c, c, c + 3, 999, 5]) for c in known}
        changes = [(c, r.randrange(12), None if r.random() < 0.2 else 1000 + c) for c in sorted(known) for _ in range(r.choice([0, 1, 2]))]
        changes = list({(c, p): (c, p, s) for c, p, s in changes}.values())
        heads = [*r.sample(sorted(known), 25), 777, 500]
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        graph = chains(frame(edges, "a long, b long, pos int"))
        seeds = frame([(h, h) for h in sorted(set(heads))], "seed long, node long")
        found = closure(frame(edges, "a long, b long, pos int"), seeds)
        assert sorted((x.seed, x.node) for x in found.collect()) == sorted((h, c) for h in set(heads) for c in known[h])
        made, timed = frame(changes, "commit_id long, path_id long, snapshot_id long"), frame(list(times.items()), "node long, time long")
        got = {}
        for x in trees(graph, seeds, made, timed, deletions=True).collect():
            got.setdefault(x.seed, {})[x.path_id] = x.snapshot_id
        assert got == {h: t for h in set(heads) if (t := tree_of(h, known, changes, times))}
        points = graph.locate(frame([(c,) for c in known], "node long"), "node")
        late = {x.node: x.latest for x in latest_times(graph, timed, points).collect()}
        assert late == {c: max((times[a] for a in known[c] if times[a] is not None), default=None) for c in known}
        if trial == 0:
            got = {(x.seed, x.path_id): x.snapshot_id for x in trees(graph, seeds, made, deletions=True).collect()}
            assert got == {(h, p): s for h in set(heads) for p, s in tree_of(h, known, changes, {}).items()}


def test_the_last_writer_wins_on_branches_of_unequal_length(spark):
    # 1 <- 2 <- 3 <- 4 <- 9 (merge) and 1 <- 8 <- 9: the old change stands on the short branch, the new one far down the long one.
    edges = [(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (8, 1, 0), (9, 8, 0), (9, 5, 1), (10, 9, 0)]
    changes = [(1, 1, 11), (2, 1, 21), (8, 2, 82), (2, 2, 22), (1, 3, 13), (8, 3, None), (2, 4, 24), (8, 4, 84), (9, 4, 94)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    graph = chains(frame(edges, "a long, b long, pos int"))
    for late, want in ((2, 22), (8, 82)):
        times = frame([(c, 100 if c == late else c) for c in (1, 2, 3, 4, 5, 8, 9, 10)], "node long, time long")
        tree = trees(graph, frame([(10, 10)], "seed long, node long"), frame(changes, "commit_id long, path_id long, snapshot_id long"), times, deletions=True)
        assert {x.path_id: x.snapshot_id for x in tree.collect()} == {1: 21, 2: want, 3: None, 4: 94}


def test_a_deep_history_takes_few_rounds(spark, monkeypatch):
    from stratalog.operators import graph as module

    rounds = []
    monkeypatch.setattr(module, "materialized", lambda df: rounds.append(1) or materialized(df))
    n = 200_000
    main = spark.range(2, n + 1).selectExpr("id AS a", "id - 1 AS b", "0 AS pos")
    # Every thousandth commit has a side branch of three commits that is merged ten commits later.
    side = spark.range(1, n // 1000).selectExpr("id * 1000 AS at", "1000000 + id * 10 AS s").selectExpr("inline(array(named_struct('a', s, 'b', at, 'pos', 0), named_struct('a', s + 1, 'b', s, 'pos', 0), named_struct('a', s + 2, 'b', s + 1, 'pos', 0), named_struct('a', at + 10, 'b', s + 2, 'pos', 1)))")
    edges = main.unionByName(side)
    found = closure(edges, spark.createDataFrame([(1, n), (2, 150_000), (3, 1_000_012)], "seed long, node long"))
    counts = {x.seed: x["count"] for x in found.groupBy("seed").count().collect()}
    assert counts == {1: n + 3 * (n // 1000 - 1), 2: 150_000 + 3 * 149, 3: 1003} and len(rounds) < 30


def test_running_figures_over_blocks(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "big", "big", "big", f"g{k % 40}"]), k // 3, r.choice([None, r.randrange(99)])) for k in range(900)]
    df = spark.createDataFrame([(g, o, k, v) for k, (g, o, v) in enumerate(rows)], "g string, o long, k long, v long")
    blocks = Blocks(df, ["g"], ["o", "k"], blocks=16)
    assert blocks.rows.where("g = 'big'").select("_block").distinct().count() > 4
    total, last, want = {}, {}, {}
    for k, (g, _, v) in enumerate(rows):
        before = last.get(g)
        total[g] = total.get(g) if v is None else (total.get(g) or 0) + v
        want[k] = (total[g], before)
        last[g] = v
    got = {x.k: x.sum for x in blocks.running("sum", F.col("v")).collect()}
    lag = {x.k: x.lag for x in blocks.previous("lag", F.col("v")).collect()}
    assert {k: (got[k], lag[k]) for k in got} == want
    peers = {x.k: x.top for x in Blocks(df, ["g"], ["o"], blocks=16).running("top", F.col("v"), "max", "range").collect()}
    assert peers == {k: max((v for g, o, v in rows if g == rows[k][0] and o <= rows[k][1] and v is not None), default=None) for k in range(900)}


def test_order_statistics(spark):
    r = random.Random(4)
    rows = [(r.choice("abbbbbb"), r.choice([None, *range(12)])) for _ in range(700)] + [("none", None), (None, 5), ("one", 3), ("two", 1), ("two", 8)]
    got = {x.g: (x.n, x.low, x.high) for x in order_statistics(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want[g] = (len(v), v[(len(v) - 1) // 2], v[len(v) // 2])
    assert got == want


def test_join_of_frequent_keys(spark):
    rows = spark.range(60_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5000 END AS key")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key <> 11")
    got = join_frequent(rows, facts, "key", "n")
    assert sorted(map(tuple, got.select("id", "n").collect())) == sorted(map(tuple, rows.join(facts, "key").select("id", "n").collect()))


def test_h_index_by_counts(spark):
    r = random.Random(8)
    rows = [(u, r.choice([1, 1, 2, 3, 5, 9, 40])) for u in range(12) for _ in range(r.choice([1, 4, 30]))]
    for offset in (0, 1):
        got = {x.u: x.h for x in metrics._h_index(spark.createDataFrame(rows, "u long, v long"), "u", "v", "h", offset).collect()}
        for u, h in got.items():
            v = sorted((x for w, x in rows if w == u), reverse=True)
            assert h == sum(x >= k - offset for k, x in enumerate(v, 1))


@pytest.fixture(scope="module")
def small(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    commits = [(k, "h", u, t + 5, u, t, "é" * k) for k, u, t in [(1, 1, 0), (2, 1, 100), (3, 2, 300), (4, 3, 700), (5, 1, 50)]]
    return History({
        "projects": table([(1, "u1", "generic", 20), (2, "u2", "small", 10), (3, "u3", "small", None)], "project_id long, url string, substore string, created long"),
        "project_metadata": table([(1, '{"stargazers_count": 3, "homepage": "", "created_at": "2020-01-01T00:00:00Z", "license": {"name": "MIT"}, "default_branch": "main"}'), (2, "{broken"), (3, '{"default_branch": "x"}')], "project_id long, json string"),
        "project_logs": table([(1, 5000, False), (1, 4000, True), (2, 9, True)], "project_id long, time long, is_error boolean"),
        "project_heads": table([(1, "refs/heads/main", 4, ""), (2, "refs/heads/main", 5, ""), (3, "refs/heads/x", 1, "")], "project_id long, name string, commit_id long, hash string"),
        "commits": table(commits, "commit_id long, hash string, committer_id long, committer_time long, author_id long, author_time long, message string"),
        "commit_parents": table([(4, 0, 3), (3, 0, 2), (2, 0, 1), (5, 0, 1)], "commit_id long, pos int, parent_id long"),
        "commit_changes": table([(1, 1, 7), (2, 2, 8), (3, 2, None), (4, 3, 9), (5, 3, 9)], "commit_id long, path_id long, snapshot_id long"),
        "paths": table([(1, "a.py"), (2, "b.c"), (3, "d.py")], "path_id long, location string"),
        "users": table([(1, "x@y"), (2, "z@y"), (3, "w@y")], "user_id long, email string"),
        "snapshots": table([(7, "1\n2\n"), (9, "\n")], "snapshot_id long, contents string"),
    })


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_project_metrics(small):
    counts = rows(metrics.counts(small), "project_id")
    assert (counts[1].commits, counts[1].authors) == (4, 3) and counts[3].commits == 1
    gaps = rows(metrics.commit_gaps(small), "project_id")
    assert (gaps[1].max_gap, gaps[1].mean_gap) == (400, 233) and (gaps[3].max_gap, gaps[3].mean_gap) == (0, 0)
    assert rows(metrics.commit_gaps(small, compat=True), "project_id")[1].mean_gap == 235
    state = rows(metrics.update_state(small), "project_id")
    assert state[1].latest_update == 5000 and state[2].latest_update == -1 and not state[2].is_valid
    assert rows(metrics.activity(small), "project_id")[1].is_abandoned
    ends = rows(metrics.end_commits(small), "project_id")
    assert (ends[1].oldest, ends[1].newest) == (1, 4)
    shares = rows(metrics.contributions(small), "project_id", "author_id")
    assert [shares[1, a].percent for a in (1, 2, 3)] == [50, 75, 100]
    assert {r.author_id for r in metrics.main_contributors(small, 50).where("project_id = 1").collect()} == {1}
    locs = rows(metrics.project_locs(small), "project_id")
    assert (locs[1].locs, locs[3].locs) == (3, 2) and 2 not in locs
    assert {(r.project_id, r.name, r.commit_id) for r in metrics.default_heads(small).collect()} == {(1, "refs/heads/main", 4), (3, "refs/heads/x", 1)}
    assert {r.author_id for r in metrics.default_commits(small).collect()} == {3, 1}
    m = rows(small.metadata, "project_id")
    assert (m[1].stargazers_count, m[1].homepage, m[1].license, m[1].created) == (3, "", "MIT", 1_577_836_800) and m[2].homepage is None


def test_originality_and_forks(small):
    origin = rows(metrics.snapshot_origins(small), "snapshot_id")
    assert (origin[7].copies, origin[7].original) == (3, 2) and (origin[9].copies, origin[9].original) == (2, 2)
    original = rows(metrics.originality(small), "project_id")
    assert (original[2].original_files, original[2].impact, original[1].duplicated_code) == (2, 5, 100)
    assert {(r.project_id, r.fork_id) for r in metrics.forks(small).collect()} == {(2, 1)}


def test_user_metrics(small):
    h = rows(metrics.h_indices(small), "user_id")
    assert (h[1].h_index1, h[1].h_index2) == (2, 1) and rows(metrics.h_indices(small, compat=True), "user_id")[1].h_index2 == 2
    assert rows(metrics.developer_experience(small), "user_id")[1].developer_experience == 1
    assert rows(metrics.user_times(small), "user_id")[1].author_experience == 100


def test_sinks(spark, tmp_path):
    text = ['say "x"', "two\nlines", "", None, "a,b", " padded "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "id int, t string")
    assert [r.t for r in round_trip_csv(df).orderBy("id").collect()] == text
    nested = flat(spark.createDataFrame([([1, None, 2], (3, 4))], "ids array<int>, pair struct<a: int, b: int>"))
    assert [tuple(r) for r in nested.collect()] == [("1 2", 3, 4)]
    into_csv(nested, str(tmp_path / "csv"), single_file=True)
    files = spark.createDataFrame([(1, "a"), (2, None)], "snapshot_id long, contents string")
    assert [r[0] for r in into_files(files, str(tmp_path / "files")).collect()] == [2] and (tmp_path / "files/1").read_text() == "a"
    into_csv(df, str(tmp_path / "named"), single_file=True, headers=["number", "what"])
    assert next((tmp_path / "named").glob("*.csv")).read_text().startswith("number,what\n")


def test_files_of_changes_and_trees(small, tmp_path):
    skipped = changes_into_files(small, small.commit_changes, str(tmp_path / "changes")).collect()
    assert [tuple(r) for r in skipped] == [(2, 8)] and (tmp_path / "changes/a.py").read_text() == "1\n2\n" and (tmp_path / "changes/d.py").read_text() == "\n"
    tree = small.commit_changes.where("commit_id in (1, 3)")
    assert [r.path_id for r in tree_into_files(small, tree, str(tmp_path / "trees")).collect()] == [2] and (tmp_path / "trees/h/a.py").exists()
    dump(small, str(tmp_path / "dump"))
    assert (tmp_path / "dump/blobs/9").read_text() == "\n" and (tmp_path / "dump/commit_changes").is_dir()


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    good = [(k, f"d{k % 3}/f{k}", f"text {k}".encode()) for k in range(200)]
    bad = [(900, "../out", b"x"), (901, None, b"x"), (902, "no", None), (903, "/abs", b"x")]
    schema = "id long, name string, contents binary"
    skipped = write_files(spark.createDataFrame(good + bad, schema).repartition(5), ["id"], str(tmp_path / "a"))
    assert sorted(r.id for r in skipped.collect()) == [900, 901, 902, 903] == sorted(r.id for r in spark.read.json(f"file://{tmp_path}/a/_skipped").collect())
    files = {str(f.relative_to(tmp_path / "a")): f.read_bytes() for f in (tmp_path / "a").glob("d*/*")}
    assert files == {n: c for _, n, c in good} and not list((tmp_path / "a/_attempts").iterdir()) and not (tmp_path / "out").exists()
    torn = spark.createDataFrame([*good[:150], (950, "n" * 300, b"x"), *good[150:]], schema).repartition(3)  # a name that no file can have
    with pytest.raises(Exception, match="too long"):
        write_files(torn, ["id"], str(tmp_path / "b"))
    assert not [f for f in (tmp_path / "b").rglob("*") if f.is_file()]
    write_files(spark.createDataFrame(good, schema), ["id"], str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("d*/*"))) == 200


def test_timings(spark, tmp_path):
    timings = Timings()
    timings.step("ten", spark.range(10), lambda df: df.write.parquet(f"{tmp_path}/ten"))
    timings.step("none", spark.range(0), lambda df: df.write.parquet(f"{tmp_path}/none"))
    timings.into_csv(spark, f"{tmp_path}/times")
    read = spark.read.option("header", True).csv(f"{tmp_path}/times").collect()
    assert [(r.step, r.rows) for r in read] == [("ten", "10"), ("none", "0")] and all(float(r.seconds) > 0 for r in read)


def test_stores_are_merged_by_content(small, spark):
    far = History({name: df.withColumns({c: F.col(c) + 2 for c in ("project_id", "commit_id", "parent_id", "author_id", "committer_id", "user_id", "path_id", "snapshot_id") if c in df.columns}) for name, df in small.tables.items()})
    far.tables["projects"] = far.tables["projects"].withColumn("url", F.when(F.col("url") == "u3", "u9").otherwise(F.col("url")))
    for h in (small, far):  # commits are told apart by their hashes
        h.tables["commits"] = h.tables["commits"].withColumn("hash", F.concat(F.lit("h"), (F.col("author_time") * 7).cast("string")))
    both = merged([small, far])
    assert sorted(r.url for r in both.projects.collect()) == ["u1", "u2", "u3", "u9"]
    for name in ("commits", "users", "paths", "commit_parents", "commit_changes", "snapshots"):
        assert both.tables[name].count() == small.tables[name].count() and both.tables[name].columns == small.tables[name].columns
    alone = rows(metrics.counts(small).join(small.projects, "project_id"), "url")
    found = rows(metrics.counts(both).join(both.projects, "project_id"), "url")
    for url, like in (("u1", "u1"), ("u2", "u2"), ("u3", "u3"), ("u9", "u3")):
        assert [found[url][c] for c in ("commits", "authors", "committers", "users")] == [alone[like][c] for c in ("commits", "authors", "committers", "users")]


def test_merging_makes_only_the_tables_that_are_asked_for(small, spark):
    asked = []

    class Asked(dict):
        def __getitem__(self, name):
            asked.append(name)
            return super().__getitem__(name)

    far = {name: df.withColumns({c: F.col(c) + 2 for c in ("path_id",) if c in df.columns}) for name, df in small.tables.items()}
    both = merged([History(Asked(small.tables)), History(Asked(far))])
    assert sorted(r.location for r in both.paths.collect()) == sorted(r.location for r in small.paths.collect())
    assert set(asked) == {"paths", "commit_changes"}


def test_entities_are_numbered_without_gaps_and_named_first_once(small, spark):
    twice = small.users.withColumn("user_id", F.col("user_id") + 100).unionByName(small.users)
    other = History({**small.tables, "users": twice})
    found = entity_ids([other, small], "user").collect()
    n = max(r.id for r in found)
    assert {r.id for r in found} == set(range(1, n + 1)) and sum(r.first for r in found) == n
    assert all(r.first == ((r.store, r.old) == min((o.store, o.old) for o in found if o.id == r.id)) for r in found)
    emails = {r.user_id: r.email for r in twice.collect()}
    by_id = sorted({(r.id, emails[r.old]) for r in found if r.old in emails})
    assert len(by_id) == small.users.count() and [e for _, e in by_id] == sorted(e for _, e in by_id)


def test_an_id_is_found_in_one_row_group(spark, tmp_path):
    n = 60_000
    tables = {name: spark.range(5).withColumnRenamed("id", f"{name[:-1]}_id") for name in ("projects", "users", "paths", "snapshots")}
    tables |= {name: spark.range(3) for name in ("project_metadata", "project_logs", "project_heads", "commit_parents", "commit_changes")}
    tables["commits"] = spark.range(n).selectExpr("id AS commit_id", "md5(cast(id AS string)) AS hash", "repeat(sha2(cast(id AS string), 256), 20) AS message")
    write_by_id(History(tables), str(tmp_path), ids_per_block=20_000)
    h = ById.at_path(spark, str(tmp_path), ids_per_block=20_000)

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        nodes = [plan]
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan parquet"):
                return node.metrics().apply("numOutputRows").value(), node.metrics().apply("numFiles").value()
            nodes += [node.children().apply(k) for k in range(node.children().size())]

    assert h.by_id("commits", 33_333).first().hash == hashlib.md5(b"33333").hexdigest()
    rows_read, files = scanned(h.by_id("commits", 33_333).select("message"))
    groups = [g.row_group(k) for f in (tmp_path / "commits.parquet/id_block=1").glob("*.parquet") for g in [pq.ParquetFile(f).metadata] for k in range(g.num_row_groups)]
    assert [g.num_rows for g in groups if g.column(0).statistics.min <= 33_333 <= g.column(0).statistics.max] == [rows_read] and len(groups) > 1 and rows_read < 20_000
    assert files == len(list((tmp_path / "commits.parquet/id_block=1").glob("*.parquet")))
    assert h.by_id("commits", n + 5).count() == 0 and h.by_hash(hashlib.md5(b"77").hexdigest()).first().commit_id == 77
    assert h.commits.columns == ["commit_id", "hash", "message"] and h.commits.count() == n


def test_sides_of_maps_and_lists(spark):
    rows = spark.createDataFrame([({"a": 1, "b": None}, [(1, "x"), (2, "y")], (5, "z")), (None, None, None)], "m map<string, int>, l array<struct<n: int, s: string>>, p struct<n: int, s: string>")
    got = rows.select(*[side(rows, c, at).alias(f"{c}{at}") for c in "mlp" for at in (0, 1)], dropped(rows, "l", 0).alias("rest"), dropped(rows, "p", 1).alias("other")).collect()
    first = got[0]
    assert sorted(first.m0) == ["a", "b"] and dict(zip(first.m0, first.m1)) == {"a": 1, "b": None}
    assert (first.l0, first.l1, first.p0, first.p1) == ([1, 2], ["x", "y"], 5, "z") and [tuple(r) for r in first.rest] == [("x",), ("y",)] and tuple(first.other) == (5,)
    assert all(x is None for x in got[1])


def test_groups_without_rows_stay(spark):
    rows = Selection.of(spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1), (4, None, 1)], "id int, g string, v int"), "id")
    kept = rows.group_by(g=F.col("g")).filter_by(F.col("v") > 4)
    assert {(r.g, r.n, r.top) for r in kept.per_group(n=F.count(F.lit(1)), top=F.max("v")).collect()} == {("a", 2, 9), ("b", 0, None), (None, 0, None)}
    lists = {r.g: r.ids for r in kept.per_group(ids=F.sort_array(F.collect_list("id"))).collect()}
    assert lists == {"a": [1, 2], "b": [], None: []}
    with pytest.raises(ValueError, match="grouped"):
        rows.per_group(n=F.count(F.lit(1)))


def test_open_selects_substores(small, spark, tmp_path):
    for name, df in small.tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    h = History.open(spark, str(tmp_path), substores=["small"], as_of=200)
    assert h.projects.count() == 2 and h.commits.count() == 3 and h.by_id("users", 2).first().email == "z@y"
    assert set(rows(metrics.counts(h), "project_id")) == {2, 3} and {r.project_id for r in h.metadata.collect()} == {2, 3}
    then = History.open(spark, str(tmp_path), as_of=200)
    assert {(r.project_id, r.commit_id) for r in then.project_heads.collect()} == {(1, 2), (2, 5), (3, 1)}
    assert {(r.project_id, r.commit_id) for r in then.full_commits.collect()} == {(1, 2), (1, 1), (2, 5), (2, 1), (3, 1)}
    contents = rows(metrics.content_counts(then), "project_id")
    assert (contents[1].paths, contents[2].paths, contents[3].paths) == (2, 2, 1)
    assert rows(then.project_logs, "time").keys() == {9} and then.commit_parents.count() == 2


def test_history_makes_only_the_tables_a_query_needs(spark):
    from stratalog.plans import queries
    from stratalog.sources.tables import shared_folder

    def folders() -> set:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        return {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}

    queries._opened.clear()
    before = folders()
    for name in ("update_state", "snapshot_layout", "snapshot_bytes", "substore_logs"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert folders() == before
    assert queries.QUERIES["default_heads"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(folders() - before) == 1


def test_files_by_id_are_as_small_as_their_rows(small, tmp_path):
    write_by_id(small, str(tmp_path), ids_per_block=2)
    sizes = [f.stat().st_size for f in tmp_path.glob("*.parquet/id_block=*/*.parquet")]
    assert len(sizes) > 5 and max(sizes) < 20_000
    assert ById.at_path(small.projects.sparkSession, str(tmp_path), ids_per_block=2).by_id("users", 2).first().email == small.by_id("users", 2).first().email


def test_fork_families_list_no_commits_but_roots(spark):
    parents = spark.createDataFrame([(2, 0, 1), (3, 0, 2), (4, 0, 2), (6, 0, 6), (7, 0, 8), (8, 0, 7), (9, 0, 7), (9, 1, 3)], "commit_id long, pos int, parent_id long")
    heads = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "a", 4), (3, "a", 5), (4, "a", 6), (5, "a", 9), (6, "a", 5)], "project_id long, name string, commit_id long")
    projects = spark.createDataFrame([(p, 10 - p) for p in range(1, 7)], "project_id long, created long")
    h = History({"commit_parents": parents, "project_heads": heads, "projects": projects})
    found = {(r.root_id, r.project_id, r.place, r.members) for r in metrics.fork_families(h).collect()}
    assert "project_commits" not in vars(h)
    assert found == {(1, 5, 1, 3), (1, 2, 2, 3), (1, 1, 3, 3), (5, 6, 1, 2), (5, 3, 2, 2)}
    listed = h.project_commits.join(parents, "commit_id", "left_anti").collect()
    assert {(r.commit_id, r.project_id) for r in listed} == {(root, project) for root, project, *_ in found}


def test_figures_of_snapshots_come_without_their_contents(small):
    found = entities.snapshots_of(small, small.commit_changes, size=F.length("contents"))
    assert "contents" not in found.columns and {(r.commit_id, r.size) for r in found.collect()} == {(1, 4), (4, 1), (5, 1)}


def test_trees_of_heads_move_once_and_read_no_times(spark, monkeypatch):
    """Seeds on one chain take their trees with all of their columns from the stretches, as they meet; commits aren't needed."""
    from stratalog.operators import graph

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = [(k, k - 1, 0) for k in range(2, 41)]
    changes = [(k, k % p, 100 * k + p if k % 3 else None) for k in range(1, 41) for p in (2, 7, 40)]
    changes = list({(c, p): (c, p, s) for c, p, s in changes}.values())
    heads = [(1, "main", 40), (1, "dev", 38), (2, "fork", 40), (3, "old", 9), (4, "root", 1), (5, "gone", 900)]
    made = []

    def commits():
        made.append("commits")
        return frame([(k, k) for k in range(1, 41)], "commit_id long, committer_time long")

    monkeypatch.setattr(graph, "_of_several", lambda *_: pytest.fail("gathered"))
    plain = {"commit_parents": lambda: frame(edges, "commit_id long, parent_id long, pos int"), "commit_changes": lambda: frame(changes, "commit_id long, path_id long, snapshot_id long"), "project_heads": lambda: frame(heads, "project_id long, name string, commit_id long")}
    h = History(Lazy(plain | {"commits": commits}))
    last = lambda c: {p: s for k, p, s in sorted(changes, key=lambda x: x[0]) if k <= c}
    got = sorted((r.project_id, r.name, r.path_id, r.snapshot_id) for r in metrics.head_trees(h).collect())
    assert got == sorted((i, n, p, s) for i, n, c in heads if c <= 40 for p, s in last(c).items() if s is not None) and not made


def test_columns_of_merged_stores_number_only_what_they_name(small, spark):
    m = merged([small, small.of_substores(["small"])])
    changes = m.columns("commit_changes", "commit_id", "path_id")
    commits = m.columns("commits", "commit_id", "author_id")
    assert sorted(m.ids.made) == ["commit", "path", "user"] and not m.tables.made
    whole = merged([small, small.of_substores(["small"])])
    bag = lambda df: sorted(map(str, df.collect()))
    assert bag(changes) == bag(whole.commit_changes.select("commit_id", "path_id"))
    assert bag(commits) == bag(whole.commits.select("commit_id", "author_id"))


def test_distinct_pairs_take_more_tasks_the_more_rows_there_are(spark):
    rows = spark.range(9000).select((F.col("id") % 30).alias("project_id"), (F.col("id") % 700).alias("path_id"))
    found = distinct_of(rows, rows, most=500)
    assert found.rdd.getNumPartitions() == 19 and found.count() == len({(k % 30, k % 700) for k in range(9000)})


def test_blocks_leave_rows_where_they_are(spark):
    """What other blocks hold comes to the rows, also where no table counts as small; and so do the sums of whole groups."""
    values = [(None if g == 3 else g, k, k % 5) for g, n in ((1, 400), (2, 1), (3, 90), (4, 7)) for k in range(n)]
    df = spark.createDataFrame(values, "g long, k long, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Blocks(df, ["g"], ["k"], blocks=16).runnings({"up_to": F.col("v"), "place": F.lit(1)}, wholes={"whole": F.col("v")})
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        got = sorted((-1 if r.g is None else r.g, r.k, r.up_to, r.place, r.whole) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = []
    for g in sorted({x[0] for x in values}, key=lambda x: -1 if x is None else x):
        mine = [v for h, _, v in sorted(values, key=lambda x: x[1]) if h == g]
        expected += [(-1 if g is None else g, k, sum(mine[: k + 1]), k + 1, sum(mine)) for k in range(len(mine))]
    assert got == expected


def test_extended_rows_make_shared_figures_once(small, monkeypatch):
    from stratalog.sources import layouts

    made = []
    for name in ("contributions", "counts", "commit_gaps", "holdings"):
        plain = getattr(metrics, name)
        monkeypatch.setattr(metrics, name, lambda *a, plain=plain, name=name, **k: made.append(name) or plain(*a, **k))
    layouts.project_rows(small, extended=True)
    assert sorted(made) == ["commit_gaps", "contributions", "contributions", "counts", "holdings"]


def test_changes_of_trees_are_moved_without_the_commit(spark):
    """A commit is found again by its place; so it isn't carried with every change."""
    edges = spark.createDataFrame([(3, 1), (3, 2), (2, 1)], "a long, b long")
    changes = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 8, 80)], "commit_id long, path_id long, snapshot_id long")
    found = trees(chains(edges), spark.createDataFrame([(3, 3)], "seed long, node long"), changes)
    moved = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x or "Window [" in x]
    assert moved and not any("commit_id" in x for x in moved)
    assert sorted((r.path_id, r.snapshot_id) for r in found.collect()) == [(7, 71), (8, 80)]
