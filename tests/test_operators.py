"""Operators on small inputs: ties, nulls, caps, empty tables, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.operators import graph as G
from loomgraph.operators import intervals as I
from loomgraph.operators import queue as Q
from loomgraph.operators import review as R
from loomgraph.operators import versioning as V
from loomgraph.sources import readers, writers
from loomgraph.streaming import queries as S

EDGE = "source string, kind string, target string, confidence int"


def keys(spark, *k):
    return spark.createDataFrame([(x,) for x in k], "node_key string")


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).head()[0]


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_first_discoveries(spark, seed):
    rng = random.Random(seed)
    rows = list({(f"n{rng.randrange(12)}", rng.choice(["calls", "contains"]), f"n{rng.randrange(12)}"): rng.randrange(1001) for _ in range(25)}.items())
    edges = [(*k, c) for k, c in rows]
    got = {r.node_key: (r.depth, r.idx, r.parent) for r in G.bfs(spark.createDataFrame(edges, EDGE), keys(spark, "n0", "n5"), "out", 3)[0].collect()}
    seen, queue = {"n0": (0, 1, None), "n5": (0, 2, None)}, ["n0", "n5"]
    for at in queue:
        if seen[at][0] < 3:
            for _, _, other in sorted(((0 if k == "contains" else 4), 0, t) for s, k, t in (e[:3] for e in edges) if s == at):
                if other not in seen:
                    seen[other] = (seen[at][0] + 1, len(seen) + 1, at)
                    queue.append(other)
    assert got == seen


def test_search_stops_at_its_budget(spark):
    hub = spark.createDataFrame([("h", "calls", f"x{i:02}", 900) for i in range(30)], EDGE)
    found, short = G.bfs(hub, keys(spark, "h"), "out", 2, max_nodes=10)
    assert short and [r.node_key for r in found.orderBy("idx").collect()] == ["h", *(f"x{i:02}" for i in range(9))]
    found, short = G.bfs(hub, keys(spark, "h"), "out", 2, max_nodes=31)
    assert not short and found.count() == 31


def test_neighbours_of_both_sides_hold_the_node(spark):
    e = spark.createDataFrame([("a", "calls", "b", 1), ("a", "calls", "a", 1)], EDGE)
    assert {r.neighbour for r in G.neighbours(e, keys(spark, "b"), "both").collect()} == {"a", "b"}
    assert G.neighbours(e, keys(spark), "both").count() == 0
    assert {r.node_key: r.degree for r in G.degree(e).collect()} == {"a": 3, "b": 1}


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "calls", "b", 900), ("b", "calls", "c", 500), ("a", "contains", "c", 100)], EDGE)
    assert [(r["from"], r.to) for r in G.shortest_path(e, "a", "c").collect()] == [("a", "c")]
    assert G.shortest_path(e, "a", "a").count() == 0 and G.shortest_path(e, "c", "a").count() == 0
    with pytest.raises(ValueError):
        G.shortest_path(e, "a", "c", "both")


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    parent = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node_key: r.component for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == parent


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")], "source string, target string")
    assert {tuple(r.members) for r in G.cycles(e).collect()} == {("a", "b"), ("c", "d")}


def test_a_weak_newer_row_hides_a_strong_older_one(spark):
    chain = spark.createDataFrame([("a", 1, False, 900), ("a", 2, False, 100), ("b", 1, False, 900), ("b", 2, True, 900), ("c", 1, True, 1), ("c", 2, False, 700)], "k string, chain_pos int, removed boolean, confidence int")
    assert [r.k for r in V.at_snapshot(chain, ["k"], floor=F.col("confidence") >= 500).collect()] == ["c"]
    assert V.at_snapshot(chain.limit(0), ["k"]).count() == 0


def test_overlay_is_flatten(spark):
    rows = lambda *x: spark.createDataFrame([(k, v) for k, v in x], "k int, v string")
    base, d1, d2 = rows((1, "a"), (2, "b"), (3, "c")), (rows((2, "B"), (4, "d")), rows((3, ""))), (rows((3, "C")), rows((1, "")))
    step = V.overlay(V.overlay(base, *d1, ["k"]), *d2, ["k"])
    assert sorted(map(tuple, V.flatten(base, [d1, d2], ["k"]).collect())) == sorted(map(tuple, step.collect())) == [(2, "B"), (3, "C"), (4, "d")]


def test_assignment_is_one_to_one_and_leaves_ties(spark):
    pairs = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.7), ("c", "z", 1.0), ("c", "w", 1.0)]
    for seed in range(2):
        random.Random(seed).shuffle(pairs)
        got = {(r.a, r.b) for r in V.assign(spark.createDataFrame(pairs, "a string, b string, similarity double").repartition(3)).collect()}
        assert got == {("a", "x"), ("b", "y")}


def test_compaction_and_rebuild_differ_at_the_limit(spark):
    assert one(spark, V.compaction(F.lit(20), F.lit(0.1))) == "keep" and one(spark, V.compaction(F.lit(21), F.lit(0.0))) == "chain_depth"
    none = F.array().cast("array<string>")
    assert one(spark, V.rebuild(none, F.lit(20), F.lit(0.0))) == "compact_then_incremental" and one(spark, V.rebuild(none, F.lit(19), F.lit(0.09))) == "incremental"


def test_page_says_whether_more_follow(spark):
    r = spark.range(5).withColumnRenamed("id", "k")
    assert [(x.k, x.more) for x in V.page(r, ["k"], [1], 2).collect()] == [(2, True), (3, True)]
    assert [(x.k, x.more) for x in V.page(r, ["k"], [2], 2).collect()] == [(3, False), (4, False)]


def test_risk_score_of_three_categories(spark):
    s = spark.createDataFrame([("p", "secrets", 0.95, None), ("p", "authorization", 0.8, None), ("p", "queues", 0.3, None), ("q", "queues", 0.3, "critical")], "subject string, category string, contribution double, floor string")
    assert {r.subject: (r.score, r.level) for r in R.risk_scores(s).collect()} == {"p": (0.993, "critical"), "q": (0.75, "critical")}


def test_greedy_selection_is_no_running_sum(spark):
    items = spark.createDataFrame([("c", "a", 0.9, 60, None, False, "x"), ("c", "b", 0.8, 60, 30, False, "x"), ("c", "d", 0.1, 10, None, False, "x"), ("c", "p", 0.0, 5, None, True, "y")], "cluster string, item string, score double, tokens int, cheaper_tokens int, pinned boolean, category string")
    got = {r.item: (r.taken, r.reason) for r in R.select_greedy(items, ["cluster"], 100, {}).collect()}
    assert got == {"p": (5, "selected"), "a": (60, "selected"), "b": (30, "selected"), "d": (None, "tokens")}


def test_merge_groups(spark):
    rows = [(1, "f", "s", "p", [(1, 10)], 1, 10, ["a", "b"], 0.5, 1, 1), (2, "f", None, None, [], 1, 2, [], 0.9, 1, 1), (3, "g", "s", "p", [(1, 9)], 50, 60, ["z"], 0.1, 1, 1), (4, "h", "t", "p", [(1, 9)], 1, 2, [], 0.1, 1, 1)]
    items = spark.createDataFrame(rows, "id long, fingerprint string, symbol string, predicate string, ranges array<struct<start:int,end:int>>, start int, end int, tokens array<string>, confidence double, severity int, evidence int")
    assert sorted(map(tuple, R.merge_groups(items.repartition(3)).collect())) == [(2, 1), (2, 2), (2, 3)]


def test_ranges(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 8, 9)], "k string, start int, end int")
    assert sorted((x.start, x.end, x.n) for x in I.islands(r, ["k"]).collect()) == [(1, 5, 2), (8, 9, 1)]
    s = spark.createDataFrame([("f", 1, 20, "outer"), ("f", 5, 10, "inner")], "k string, start int, end int, symbol string")
    lines = spark.createDataFrame([("f", 7), ("f", 15), ("f", 30), ("g", 1)], "k string, line int")
    assert {(x.k, x.line): x.symbol for x in I.innermost(lines, s, "k").collect()} == {("f", 7): "inner", ("f", 15): "outer", ("f", 30): None, ("g", 1): None}


def test_texts(spark):
    assert one(spark, X.claim_tokens(F.lit('The check at line 42 reads "secret" in `checkAuth`: L7'))) == ["<lit>", "check", "checkauth", "reads"]
    assert one(spark, X.identifier_parts(F.lit("parseHTTPServer_v2"))) == ["parse", "http", "server", "v", "2"]
    assert one(spark, X.http_path(F.lit("users/:id//x/?q=1"))) == "/users/{}/x" and one(spark, X.http_path(F.lit(""))) == "/"
    assert one(spark, X.package_name(F.lit("@a/b@1.2/c"))) == "@a/b" and one(spark, X.package_name(F.lit("node:fs/promises"))) == "fs"
    assert one(spark, X.line_count(F.lit("a\nb\n"))) == 2 and one(spark, X.line_count(F.lit(""))) == 0


def test_numbers(spark):
    assert one(spark, N.permille(F.lit(float("nan")))) == 0 and one(spark, N.permille(F.lit(7.0))) == 1000
    assert one(spark, N.wilson(F.lit(0), F.lit(0))) is None
    assert one(spark, N.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0


def test_rate_limit_and_chain(spark):
    ev = spark.createDataFrame([("k", i, f"2024-01-01 00:00:{i:02}") for i in range(4)], "k string, event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.limited for r in Q.rate_limited(ev, "k", "ts", 2).orderBy("event_id").collect()] == [False, False, True, True]
    log = Q.hash_chain(ev, "k", "event_id", "t")
    assert Q.chain_breaks(log, ev, "k", "event_id", "t").head().first_bad is None
    bad = ev.withColumn("t", F.when(F.col("event_id") == 2, "x").otherwise(F.col("t")))
    assert Q.chain_breaks(log, bad, "k", "event_id", "t").head().first_bad == 2


def test_files(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.ts").write_text("x")
    (tmp_path / "repo/b.bin").write_bytes(b"\x10\x00\x01")
    got = {r.path: (r.size, r.binary) for r in readers.walk(spark, str(tmp_path / "repo")).collect()}
    assert got == {"src/a.ts": (1, False), "b.bin": (3, True)}
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_snapshots_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    writers.write_snapshot(df, str(tmp_path), "s1")
    with pytest.raises(Exception):
        writers.write_snapshot(df, str(tmp_path), "s1")
    writers.compact([(df.withColumn("v", F.lit("b")), df.limit(0))], df, ["k"], str(tmp_path), "s2")
    assert writers.read_snapshot(spark, str(tmp_path), "s2").head().v == "b"
    assert writers.new_rows(df.union(df), df.limit(0), ["k"]).count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 1.0), (2, "a", "2024-01-01 00:00:10", 2.0), (3, "b", "2024-01-01 00:02:00", 4.0)], "id long, k string, t string, value double").select("id", "k", F.to_timestamp("t").alias("ts"), "value").write.parquet(src)
    schema = spark.read.parquet(src).schema
    seen = []
    S.drain(S.deduplicated(S.source(spark, src, schema), ["k"], "ts"), lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "c1"))
    assert len(seen) == 2 and 3 in seen
    out = {}
    S.drain(S.windowed_counts(S.source(spark, src, schema), "ts", "1 minute", "k"), lambda df, _: out.update({(r.bucket % 3600, r.k): (r.n, r.total) for r in df.collect()}), str(tmp_path / "c2"), "update")
    assert out == {(0, "a"): (2, 3.0), (120, "b"): (1, 4.0)}


def test_best_trail_and_caps(spark):
    from loomgraph.operators import impact as P

    e = spark.createDataFrame([("a", "calls", "s", 900), ("b", "calls", "s", 800), ("c", "calls", "a", 400), ("c", "calls", "b", 700), ("d", "calls", "c", 900)], EDGE)
    got = {r.node: (r.distance, r.confidence, r.others) for r in P.expand(e, keys(spark, "s"), "in", 2, 50).collect()}
    assert got == {"a": (1, 900, 0), "b": (1, 800, 0), "c": (2, 700, 1)}
    assert {r.node for r in P.expand(e, keys(spark, "s"), "in", 1, 1).collect()} == {"a"}


def test_oversized_clusters_are_split_at_weak_links(spark):
    from loomgraph.operators import impact as P

    links = spark.createDataFrame([(1, 2, 900), (2, 3, 100), (3, 4, 900)], "a long, b long, weight int")
    whole = spark.createDataFrame([(i, 1) for i in range(1, 5)], "member long, cluster long")
    assert {r.member: r.part for r in P.split_oversized(links, whole, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.part for r in P.split_oversized(links, whole, 12).collect()} == {1}


def test_budgets_and_jobs_fold_in_order(spark):
    from loomgraph.operators import control as C

    r = spark.createDataFrame([("k", 1, 60, 1), ("k", 2, 60, 2), ("k", 3, 40, 3), ("j", 4, 101, 1)], "key string, id int, amount int, order int")
    assert {x.id: x.granted for x in C.reserve(r, "key", 100).collect()} == {1: True, 2: False, 3: True, 4: False}
    e = [("a", 1, "claim"), ("a", 2, "fail"), ("a", 3, "claim"), ("a", 4, "complete"), ("b", 1, "complete"), ("c", 1, "claim"), ("c", 2, "fail")]
    got = {x.k: (x.state, x.attempts) for x in C.job_states(spark.createDataFrame(e, "k string, order int, what string"), "k", 1).collect()}
    assert got == {"a": ("dead", 1), "b": ("queued", 0), "c": ("dead", 1)}
    assert C.reserve(r.limit(0), "key", 1).count() == 0


def test_invalidation_takes_the_strongest_action(spark):
    from loomgraph.operators import control as C

    k = lambda *x: spark.createDataFrame([(v,) for v in x], "key string")
    e = spark.createDataFrame([("x", "calls", "a", 1), ("a", "calls", "a", 1), ("y", "reads", "a", 1)], EDGE)
    assert {r.key: r.action for r in C.invalidation(k("a"), k("a", "b"), e).collect()} == {"a": "full", "b": "rekey", "x": "summary"}
