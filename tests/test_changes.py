"""Operators of changes on fixtures."""

import re

import pytest

from loomgraph.operators import changes as C
from loomgraph.operators import review as R
from loomgraph.sources import readers as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/auth/**", "auth/a.ts", True), ("**/auth/**", "x/y/auth/b/c", True), ("**/auth/**", "xauth/a", False), ("**/payment*/**", "src/payments-v2/a", True), ("**/Dockerfile", "Dockerfile", True), ("**/Dockerfile", "a/Dockerfile.dev", False), (".*/workflows/*.yml", ".ci/workflows/a.yml", True), ("a?c.+", "abc.+", True)])
def test_globs(glob, path, hit):
    assert bool(re.match(C.glob_pattern(glob), path)) == hit


def test_path_signals(spark):
    files = spark.createDataFrame([("src/auth/a.ts", "analyze"), ("src/auth/b.ts", "generated"), ("app/billing/x", "analyze"), (None, "analyze")], "path string, disposition string")
    got = {(r.rule, r.subject, r.weight) for r in C.path_signals(files).collect()}
    assert got == {("path.auth", "src/auth/a.ts", 0.5), ("path.payments", "app/billing/x", 0.65)}
    got = {(r.rule, r.subject, r.category, r.weight, r.floor) for r in C.path_signals(files, [("src/**", "high", None), ("**/auth/**", "low", None)]).collect()}
    assert got == {("path.configured", "src/auth/a.ts", "public_api_contracts", 0.6, "high"), ("path.payments", "app/billing/x", "payments", 0.65, None)}
    assert C.inferred_category("lib/ACL/**") == "permissions" and C.path_signals(files.limit(0)).count() == 0


def test_class_signals(spark):
    rows = [("s", "authorization_changed", ["guard_removed", "guard_added"], 0.9), ("t", "authorization_changed", [], 1.0), ("u", "api_contract_changed", ["additive", "breaking"], 1.0), ("v", "exception_handling_changed", [], 1.0), ("w", "async_behavior_changed", [], 1.0)]
    got = {(r.subject, r.rule) for r in C.class_signals(spark.createDataFrame(rows, "symbol string, class string, tags array<string>, confidence double")).collect()}
    assert got == {("s", "authz.guard_removed"), ("s", "authz.guard_added"), ("t", "authz.logic_changed"), ("u", "api.breaking_change")}


def test_roll_up(spark):
    kinds = "kind string, subject string, category string, contribution double, floor string"
    s = spark.createDataFrame([("symbol", "a", "secrets", 0.95, None), ("file", "f", "authorization", 0.8, None), ("cluster", "k", "queues", 0.3, None), ("change", "", "queues", 0.1, None)], kinds)
    files = spark.createDataFrame([("a", "f"), ("b", "f")], "symbol string, file string")
    members = spark.createDataFrame([("k", "symbol", "a"), ("k", "file", "f"), ("l", "symbol", "b")], "cluster string, kind string, subject string")
    got = {(r.scope, r.key): (r.score, r.level) for r in C.roll_up(s, files, members, 3).collect()}
    assert got == {("symbol", "a"): (0.99, "critical"), ("symbol", "b"): (0.8, "critical"), ("cluster", "k"): (0.993, "critical"), ("change", ""): (0.993, "critical")}
    big = {r.scope: r.score for r in C.roll_up(s.where("kind = 'change'"), files, members.limit(0), 51).collect()}
    assert big == {"change": 0.19}


def test_chain_walk(spark):
    metas = spark.createDataFrame([(1, None, True, True), (2, 1, False, True), (3, 2, False, True), (4, 9, False, True), (5, 6, False, True), (6, 5, False, True), (7, None, False, True), (8, 1, False, False)], "id long, base long, full boolean, ready boolean")
    got = {r.id: (r.chain, r.status) for r in C.chain_walk(spark.createDataFrame([(i,) for i in (1, 3, 4, 5, 7, 8, 42)], "id long"), metas).collect()}
    assert got == {1: ([1], "ok"), 3: ([1, 2, 3], "ok"), 4: (None, "broken"), 5: (None, "broken"), 7: (None, "broken"), 8: (None, "not_ready"), 42: (None, "not_found")}


def test_hunks_rebuild_the_new_text(spark):
    old = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate("abcd")] + [("g", 1, "z")], "path string, no int, line string")
    hunks = spark.createDataFrame([("f", 1, "add", None, "0"), ("f", 2, "context", 1, "a"), ("f", 3, "del", 2, "b"), ("f", 4, "add", None, "B1"), ("f", 5, "add", None, "B2")], "path string, seq int, kind string, old_no int, text string")
    assert {r.path: r.text for r in C.apply_hunks(old, hunks, "path").collect()} == {"f": "0\na\nB1\nB2\nc\nd", "g": "z"}


def test_pinned_items_come_by_kind(spark):
    items = spark.createDataFrame([("c", "a", 0.9, 60, None, True, "x", "other"), ("c", "b", 0.1, 60, None, True, "x", "changed_symbol"), ("c", "d", 0.2, 30, None, True, "x", "class_signature"), ("c", "e", 0.4, 40, 10, False, "x", None), ("c", "g", 0.5, 40, 10, False, "x", None)], "cluster string, item string, score double, tokens int, cheaper_tokens int, pinned boolean, category string, kind string")
    got = {r.item: (r.taken, r.reason) for r in R.select_greedy(items, ["cluster"], 100, {}).collect()}
    assert got == {"b": (60, "selected"), "d": (30, "selected"), "a": (None, "tokens"), "g": (10, "selected"), "e": (None, "tokens")}


def test_interpreters_and_canonical_json(spark):
    rows = [("x", "#!/usr/bin/env -S node --flag", "javascript"), ("x", "#!/bin/dash -e", "shell"), ("x", "#!/usr/bin/python3.11", "python"), ("x", "#!/usr/bin/env tsx", "typescript"), ("x", "no", None), ("x", None, None), ("a.py", "#!/bin/sh", "python")]
    d = spark.createDataFrame(rows, "p string, l string, want string")
    assert d.select(S.language(F.col("p"), F.col("l")).eqNullSafe(F.col("want")).alias("ok")).where("not ok").count() == 0
    j = spark.createDataFrame([('{"b": [1, 2.5, {"y": null, "x": "é"}], "a": true}',), ("{",), (None,)], "t string")
    assert [r.j for r in j.select(C.canonical_json(F.col("t")).alias("j")).collect()] == ['{"a":true,"b":[1,2.500000,{"x":"é","y":null}]}', None, None]
