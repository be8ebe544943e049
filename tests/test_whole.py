"""Queries and operators do the whole job: no subsets, no caps."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import review as R
from loomgraph.operators import versioning as V


def test_merge_groups_are_those_of_all_pairs(spark):
    """A hot symbol of many alike findings, against every pair; fewer than one link a pair are made."""
    rng = random.Random(5)
    some = lambda: [rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 5]))]
    rows = []
    for i in range(240):
        at, line = rng.randrange(400), rng.randrange(300)
        rows.append((i, f"f{rng.randrange(230)}", rng.choice(["hot", "hot", "s", "t", None]), rng.choice(["p", "q", None]), [] if i % 7 == 0 else [(line, line + rng.choice([3, 8]))], None if i % 11 == 0 else at, at + rng.choice([0, 4, 9]), some(), rng.random(), 1, 1))
    items = spark.createDataFrame(rows, "id long, fingerprint string, symbol string, predicate string, ranges array<struct<start:int,end:int>>, start int, end int, tokens array<string>, confidence double, severity int, evidence int")
    lines = lambda r: {k for a, b in r[4] for k in range(a, b + 1)}
    share = lambda a, b, empty: len(a & b) / len(a | b) if a | b else empty
    label = {r[0]: r[0] for r in rows}

    def find(n):
        return n if label[n] == n else find(label[n])

    for i, x in enumerate(rows):
        for y in rows[:i]:
            ranges = x[3] and x[3] == y[3] and share(lines(x), lines(y), 0) >= 0.5
            claims = x[5] is not None and y[5] is not None and x[5] <= y[6] and y[5] <= x[6] and share(set(x[7]), set(y[7]), 1) >= 0.6
            if x[1] == y[1] or (x[2] and x[2] == y[2] and (ranges or claims)):
                label[find(x[0])] = find(y[0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r)
    want = {(max(g, key=lambda r: r[8])[0], r[0]) for g in groups.values() if len(g) > 1 for r in g}
    assert len({p for p, _ in want}) > 5 and {tuple(r) for r in R.merge_groups(items.repartition(3)).collect()} == want


def test_hot_symbol_does_not_make_all_pairs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(R, "components", lambda links: made.append(links.count()) or G.components(links))
    items = spark.range(600).selectExpr("id", "cast(id as string) as fingerprint", "'s' as symbol", "'p' as predicate", "array(named_struct('start', 1, 'end', 9)) as ranges", "1 as start", "9 as end", "array('a') as tokens", "0.5D as confidence", "1 as severity", "1 as evidence")
    assert R.merge_groups(items).count() == 600 and made[0] <= 3 * 600


@pytest.mark.parametrize("name, table, key, column", [("c5_merge_groups", "orders", "o_orderkey", "member"), ("k11_audit_chain", "events", "event_id", "event_id"), ("c2_cluster_split", "customer", "c_custkey", "member")])
def test_folds_run_over_whole_tables(spark, name, table, key, column):
    """Rows that the subset filters left out have results too."""
    import __spark_entry__

    d = f"/root/testdata/{'sf0.01' if table == 'events' else 'sf0.001'}"
    got, rows = __spark_entry__.queries()[name](spark, d), spark.read.parquet(f"{d}/{table}.parquet")
    if name == "c5_merge_groups":
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey", "o_orderpriority"))).where("n > 1")
    if name == "c2_cluster_split":
        rows = rows.join(spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    assert rows.count() > 0 and rows.join(got, F.col(f"{column}") == rows[key] if column != key else key, "left_anti").count() == 0


@pytest.mark.parametrize("rounds", [32, 2])
def test_assignment_ends_long_chains(spark, rounds):
    """A chain resolves one pair a round; with few rounds random pairs are finished in order too."""
    n, rng = 40, random.Random(3)
    pairs = [(i, 1000 + j, 1 - (i + j) / 1000) for i in range(n) for j in (i - 1, i) if j >= 0]
    # A second component of scattered pairs, each similarity once.
    scattered = sorted({(rng.randrange(2000, 2030), rng.randrange(3000, 3030)) for _ in range(150)})
    pairs += [(a, b, s / 1000) for (a, b), s in zip(scattered, rng.sample(range(900), len(scattered)))]
    a, b, want = set(), set(), set()
    for x, y, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            want.add((x, y))
    got = V.assign(spark.createDataFrame(pairs, "a long, b long, similarity double").repartition(3), rounds).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and (0, 1000) in want and (n - 1, 1000 + n - 1) in want


def test_repetition_alone_is_an_outlier(spark):
    """Texts that are normal but for repeated lines, or for repeated words under the base limit, are rejected."""
    from loomgraph.llm import quality

    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(i, "\n".join(line(8) for _ in range(10))) for i in range(300)]
    same = [line(1) for _ in range(5)]
    rows += [(1000 + i, "\n".join(f"{same[i]}\n{line(10)}" for _ in range(8)) + f"\n{same[i]}" * 4) for i in range(5)]
    rows += [(2000 + i, "\n".join([w := line(11)] + [line(9) for _ in range(6)] + [w])) for i in range(5)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(300)) and not any(r.kept for i, r in got.items() if i >= 1000)
    assert 1 / quality.RIDGE[3] ** 2 > quality.CUT and 0.3 / quality.RIDGE[4] ** 2 > quality.CUT


def test_letters_beyond_the_basic_plane_are_letters():
    from loomgraph.llm import langid

    adlam, deseret, chakma = "\U0001e900\U0001e922", "\U00010414\U0001043c", "\U00011103\U00011104"
    for t in (adlam, deseret, chakma, "\U0001d400\U0001d401", "\U00020000\U00020001"):
        assert len(langid.symbols(t)) == 4
    assert list(langid.symbols("\U00010414")) == list(langid.symbols("\U0001043c")) != list(langid.symbols("\U0001e922"))
    assert not len(langid.symbols("\U0001f600 1")) and list(langid.symbols("Ab")) == [32, 97, 98, 32]


def test_joined_secrets_are_scored_whole():
    from loomgraph.llm import secrets

    found = lambda t: [t[a:b] for k, a, b in secrets.spans_of(t) if k == "literal"]
    assert found('client_token = "Zx9!" + "kQ82" + "mP4w"') == ["Zx9!", "kQ82", "mP4w"]
    assert found('part = "Zx9!" + "kQ82" + "mP4w"\nclient_token = part') == ["Zx9!", "kQ82", "mP4w"]
    assert found('a = "Zx9!"\nb = "kQ82"\nclient_token = a + b + "mP4w"') == ["Zx9!", "kQ82", "mP4w"]
    assert found('color = "Zx9!" + "kQ82" + "mP4w"') == found('client_token = "no" + "ne"') == []
    assert found("x" * 200 + '_client_token = "Zx9!kQ82mP4w"') == ["Zx9!kQ82mP4w"]
    assert found('a = "Zx9!kQ82mP4w"\n' + "a = a + a\n" * 60 + "client_token = a") == ["Zx9!kQ82mP4w"]
