"""What a change brings: signals of risk from paths and classes, their roll-up, hunks, chains, new cycles, packages and publication."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import review as R
from loomgraph.operators.common import cut
from loomgraph.operators.graph import cycles
from loomgraph.operators.intervals import islands

# Rules of paths where none are configured, payment paths, weights of configured levels, words of a path that tell its category.
DEFAULT_PATHS = (("path.auth", ("**/auth/**", "**/security/**")), ("path.migrations", ("**/migrations/**",)), ("path.infra", ("**/Dockerfile", "**/Dockerfile.*", ".*/workflows/*.yml", ".*/workflows/*.yaml")))
PAYMENT_PATHS = ("**/payment*/**", "**/billing/**")
LEVEL_WEIGHTS = {"critical": 0.8, "high": 0.6, "medium": 0.4, "low": 0.1}
PATH_CATEGORIES = ((("auth",), "authentication"), (("permission", "policy", "acl"), "permissions"), (("payment", "billing"), "payments"), (("migration",), "database_migrations"), (("crypto", "security"), "cryptography"), (("secret",), "secrets"))
SKIPPED = ("generated", "vendored", "minified")
LARGE_CHANGE, SIZE_WEIGHT = 50, 0.1


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: `**/` any folders or none, `*` and `**` anything, `?` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        else:
            out, i = out + ("." if glob[i] == "?" else "\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def _any_glob(path: Column, globs: Sequence[str]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def inferred_category(glob: str) -> str:
    return next((c for words, c in PATH_CATEGORIES if any(w in glob.lower() for w in words)), "public_api_contracts")


def with_rules(signals: DataFrame) -> DataFrame:
    """signals (rule, subject, confidence) with category, weight and floor of their rule."""
    return signals.join(F.broadcast(R.rule_table(signals.sparkSession)), "rule").select("rule", "subject", "category", "weight", "floor", "confidence")


def path_signals(files: DataFrame, rules: Sequence[tuple[str, str, str | None]] = (), payment_paths: Sequence[str] = PAYMENT_PATHS, generated: Sequence[str] = ()) -> DataFrame:
    """rule, subject (path), category, weight, floor, confidence of files (path, disposition). The first of rules (glob, level, category or None) that matches counts; without rules the default ones do. Generated, vendored and minified files give none."""
    path = F.col("path")
    f = files.where(~F.col("disposition").isin(*SKIPPED) & ~_any_glob(path, generated)).select("path").distinct()
    found = F.array(*([] if rules else [F.when(_any_glob(path, globs), F.lit(rule)) for rule, globs in DEFAULT_PATHS]), F.when(_any_glob(path, payment_paths), F.lit("path.payments")))
    out = with_rules(f.select(F.col("path").alias("subject"), F.explode(F.array_compact(found)).alias("rule"), F.lit(1.0).alias("confidence")))
    if rules:
        first = F.coalesce(*(F.when(_any_glob(path, [g]), F.struct(F.lit(c or inferred_category(g)).alias("category"), F.lit(LEVEL_WEIGHTS[level]).alias("weight"), F.lit(level).alias("floor"))) for g, level, c in rules))
        own = f.withColumn("x", first).where("x is not null").select(F.lit("path.configured").alias("rule"), F.col("path").alias("subject"), "x.category", "x.weight", "x.floor", F.lit(1.0).alias("confidence"))
        out = out.unionByName(own)
    return out


def class_signals(classes: DataFrame) -> DataFrame:
    """rule, subject, ... of classified changes (symbol, class, tags, confidence)."""
    has = lambda t: F.array_contains("tags", t)
    authz = F.array_compact(F.array(*(F.when(has(t), F.lit(r)) for t, r in (("authz_call_removed", "authz.call_removed"), ("direct_role_comparison_added", "authz.direct_role_check"), ("guard_removed", "authz.guard_removed"), ("guard_added", "authz.guard_added")))))
    one = lambda c: F.array(c)
    k = F.col("class")
    rules = (
        F.when(k == "authorization_changed", F.when(F.size(authz) > 0, authz).otherwise(one(F.lit("authz.logic_changed"))))
        .when(k == "validation_removed", one(F.lit("validation.removed")))
        .when(k == "database_write_changed", one(F.when(has("inside_transaction"), "db.write_changed_in_tx").otherwise("db.write_changed")))
        .when(k == "transaction_boundary_changed", one(F.lit("tx.boundary_changed")))
        .when(k == "api_contract_changed", one(F.when(has("additive") & ~has("breaking"), "api.additive_change").otherwise("api.breaking_change")))
        .when((k == "async_behavior_changed") & (has("floating_promise") | has("await_removed_on_db_write")), one(F.lit("async.floating_promise")))
    )
    return with_rules(classes.select(F.col("symbol").alias("subject"), F.explode(rules).alias("rule"), "confidence"))


def all_signals(*detected: DataFrame) -> DataFrame:
    """The signals of all detectors, one a rule and subject."""
    out = detected[0]
    for d in detected[1:]:
        out = out.unionByName(d)
    return R.dedup_signals(out.withColumn("explanation", F.col("subject").cast("string")))


def roll_up(signals: DataFrame, symbol_files: DataFrame, members: DataFrame, files_changed: int, digits: int = 4) -> DataFrame:
    """scope (symbol, cluster, change), key, score, level. signals: kind (symbol, file, cluster, change), subject, category, contribution, floor; symbol_files: symbol, file; members: cluster, kind, subject.

    A symbol has its own signals and its file's, a cluster those of its symbols and files and its own; the change has the
    worst of its clusters and of its own signals (all signals where there is no cluster), and is worse if many files changed.
    """
    s = signals.select("kind", F.col("subject").alias("of"), "category", "contribution", "floor")
    cols = ["key", "category", "contribution", "floor"]
    own = s.where("kind = 'symbol'").select(F.col("of").alias("key"), *cols[1:])
    filed = symbol_files.join(s.where("kind = 'file'"), F.col("file") == F.col("of")).select(F.col("symbol").alias("key"), *cols[1:])
    clusters = members.select("cluster", F.col("kind").alias("k"), "subject").join(s, (F.col("k") == F.col("kind")) & (F.col("subject") == F.col("of"))).select(F.col("cluster").alias("key"), *cols[1:])
    clusters = clusters.unionByName(s.where("kind = 'cluster'").join(members.select("cluster").distinct(), F.col("of") == F.col("cluster"), "left_semi").select(F.col("of").alias("key"), *cols[1:]))
    score = lambda df, scope: R.risk_scores(df, "key", digits=digits).select(F.lit(scope).alias("scope"), F.col("key").cast("string").alias("key"), "score", "level")
    per = score(clusters, "cluster")
    whole = s.where("kind = 'change'") if members.limit(1).count() else s
    top = per.unionByName(score(whole.select(F.lit("change").alias("key"), *cols[1:]), "change"))
    best = top.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.coalesce(F.max(R.level_number(F.col("level"))), F.lit(0)).alias("l"))
    if files_changed > LARGE_CHANGE:
        best = best.withColumn("score", F.round(1 - (1 - F.col("score")) * (1 - SIZE_WEIGHT), digits))
        best = best.withColumn("l", F.greatest("l", R.level_number(R.N.risk_level(F.col("score")))))
    change = best.select(F.lit("change").alias("scope"), F.lit("").alias("key"), "score", F.get(F.array(*map(F.lit, R.LEVELS)), F.col("l")).alias("level"))
    return score(own.unionByName(filed), "symbol").unionByName(per).unionByName(change)


def changed_ranges(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side (old, new), start, end (exclusive): changed lines of hunk lines (kind, old_no, new_no), neighbouring ones as one."""
    side = F.when(F.col("kind") == "del", F.struct(F.lit("old").alias("side"), F.col("old_no").alias("no"))).when(F.col("kind") == "add", F.struct(F.lit("new").alias("side"), F.col("new_no").alias("no")))
    at = lines.withColumn("x", side).where("x.no is not null").select(*keys, "x.side", F.col("x.no").alias("start"), (F.col("x.no") + 1).alias("end")).distinct()
    return islands(at, [*keys, "side"]).drop("n")


def apply_hunks(old: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """key, text: old lines (key, no from 1, line) with hunk lines (key, seq, kind, old_no, text) applied. An added line stands where the hunk's last line of the old side before it stood."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = hunks.withColumn("after", F.coalesce(F.last("old_no", True).over(w), F.lit(0)))
    gone = hunks.where("kind = 'del'").select(F.col(key).alias("k"), F.col("old_no").alias("n"))
    kept = old.join(gone, (F.col(key) == F.col("k")) & (F.col("no") == F.col("n")), "left_anti").select(key, F.col("no").alias("a"), F.lit(0).alias("b"), "line")
    come = placed.where("kind = 'add'").select(key, F.col("after").alias("a"), F.col("seq").alias("b"), F.col("text").alias("line"))
    return kept.unionByName(come).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "line"))), lambda x: x.line), "\n").alias("text"))


def chain_walk(ids: DataFrame, metas: DataFrame, max_depth: int = 64) -> DataFrame:
    """id, chain (root first) and status (ok, not_found, broken, not_ready) of ids over metas (id, base, full, ready): base pointers are followed to a full snapshot."""
    m = metas.select(F.col("id").alias("m_id"), "base", "full", "ready")
    now = ids.select("id", F.col("id").alias("at"), F.array().cast(f"array<{ids.schema['id'].dataType.simpleString()}>").alias("chain"))
    done = None
    for step in range(max_depth + 1):
        j = now.join(m, F.col("at") == F.col("m_id"), "left")
        status = (
            F.when(F.col("m_id").isNull(), "not_found" if step == 0 else "broken").when(~F.col("ready"), "not_ready").when(F.array_contains("chain", F.col("at")), "broken")
            .when(F.col("base").isNull(), F.when(F.col("full"), "ok").otherwise("broken")).when(F.lit(step == max_depth), "broken")
        )
        j = cut(j.select("id", "base", F.concat(F.array("at"), "chain").alias("chain"), status.alias("status")))
        end = j.where("status is not null").select("id", F.when(F.col("status") == "ok", F.col("chain")).alias("chain"), "status")
        done = end if done is None else done.unionByName(end)
        now = j.where("status is null").select("id", F.col("base").alias("at"), "chain")
        if not now.limit(1).count():
            break
    return done


def new_cycles(head: DataFrame, base: DataFrame, touched: DataFrame) -> DataFrame:
    """anchor, members: cycles of head that base does not have and that hold a touched module (node_key); the anchor is the first such member."""
    fresh = cycles(head).select("members").join(cycles(base).select("members"), "members", "left_anti")
    return fresh.withColumn("m", F.explode("members")).join(touched.select(F.col("node_key").alias("m")).distinct(), "m", "left_semi").groupBy("members").agg(F.min("m").alias("anchor")).select("anchor", "members")


def package(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, items (pinned first, then by falling score, then id) and hash of the package. items: item, pinned, score, tokens."""
    order = F.sort_array(F.collect_list(F.struct((~F.col("pinned")).alias("rest"), (-F.col("score")).alias("s"), "item", "tokens")))
    p = items.groupBy(*keys).agg(order.alias("x"))
    line = lambda x: F.concat_ws(":", x["item"], F.format_string("%.6f", -x["s"]), x["tokens"])
    return p.select(*keys, F.transform("x", lambda x: x["item"]).alias("items"), F.sha2(F.array_join(F.transform("x", line), "\n"), 256).alias("hash"))


SEVERITIES = ("critical", "high", "medium", "low", "info")


def finding_order() -> list[Column]:
    """By severity, falling confidence, path and line."""
    return [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.desc("confidence"), F.col("path"), F.col("line")]


def publication_plan(findings: DataFrame, changed: DataFrame, keys: Sequence[str], cap: int = 20) -> DataFrame:
    """findings (keys, path, line, rank, renders) with placed (inline or summary) and reason (out_of_diff, render_error, inline_cap): none is dropped. changed: keys, path, start, end (exclusive)."""
    on = [*keys, "path"]
    c = changed.select(*(F.col(k).alias(f"c_{k}") for k in on), "start", "end")
    same = F.lit(True)
    for k in on:
        same = same & (F.col(k) == F.col(f"c_{k}"))
    inside = findings.join(c, same & (F.col("line") >= F.col("start")) & (F.col("line") < F.col("end")), "left_semi").withColumn("inside", F.lit(True))
    out = findings.join(c, same & (F.col("line") >= F.col("start")) & (F.col("line") < F.col("end")), "left_anti").withColumn("inside", F.lit(False))
    all_ = inside.unionByName(out)
    fits = F.col("inside") & F.col("renders")
    n = F.sum(fits.cast("int")).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(~F.col("inside"), "out_of_diff").when(~F.col("renders"), "render_error").when(n > cap, "inline_cap")
    return all_.withColumn("reason", reason).withColumn("placed", F.when(F.col("reason").isNull(), "inline").otherwise("summary")).drop("inside")


FILTERED = ("search", "scroll", "count", "delete")


def audit_requests(requests: DataFrame) -> DataFrame:
    """requests (op, must: array of key and values, elsewhere: keys of should and must_not, payloads: array of maps) with violation, null if there is none: filters name one organisation and some repositories, points both keys."""
    one = F.exists("must", lambda x: (x["key"] == "organization_id") & (F.size(x["values"]) == 1))
    some = F.exists("must", lambda x: (x["key"] == "repository_id") & (F.size(x["values"]) > 0))
    lacks = F.exists("payloads", lambda p: ~(F.map_contains_key(p, "organization_id") & F.map_contains_key(p, "repository_id")))
    bad = F.when(F.col("op").isin(*FILTERED), F.when(~one, "no organization_id").when(~some, "no repository_id").when(F.arrays_overlap("elsewhere", F.array(F.lit("organization_id"), F.lit("repository_id"))), "tenant key elsewhere"))
    points = F.when(F.col("op") == "upsert", F.when(F.col("payloads").isNull(), "no points").when(lacks, "payload without key"))
    return requests.withColumn("violation", F.coalesce(bad, points))


def test_index(nodes: DataFrame, contains: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Cases (node_key, path, name, suite), test files (path), and whether there is no case at all. nodes: node_key, kind, name, path; contains: source, target."""
    cases = nodes.where("kind = 'test_case' and path is not null")
    suites = nodes.where("kind = 'test_suite'").select(F.col("node_key").alias("s"), F.col("name").alias("suite_name"))
    inside = contains.join(suites, F.col("source") == F.col("s")).groupBy(F.col("target").alias("t")).agg(F.max(F.struct(F.col("s").alias("suite"), "suite_name")).alias("x"))
    listed = cases.join(inside, F.col("node_key") == F.col("t"), "left").select("node_key", "path", "name", "x.suite", "x.suite_name")
    files = nodes.where(F.col("path").isNotNull() & (F.col("kind").isin("test_case", "test_suite") | X.is_test_path(F.col("path")))).select("path").distinct()
    return listed, files, not cases.limit(1).count()


def versioned_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """path, file_version, symbols (sorted): symbols (path, symbol) by file, with the id of the file's version (path, version); files without an id keep null."""
    by = symbols.groupBy("path").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return by.join(files.select("path", F.col("version").alias("file_version")), "path", "left").select("path", "file_version", "symbols")


def type_references(refs: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (id, path, type) with target and how: the type's head is a class of the file, else of an import of it, else the only class of that name. classes: path, name, key; imports: path, name, target_path."""
    head = F.regexp_extract(F.regexp_replace("type", r"^(?:readonly |Promise<|Array<)+", ""), r"^([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    r = refs.withColumn("head", head)
    c = classes.groupBy("path", "name").agg(F.min("key").alias("key"))
    here = c.select(F.col("path").alias("p1"), F.col("name").alias("n1"), F.col("key").alias("own"))
    via = imports.join(c.select(F.col("path").alias("target_path"), "name", "key"), ["target_path", "name"]).groupBy(F.col("path").alias("p2"), F.col("name").alias("n2")).agg(F.min("key").alias("imported"))
    only = classes.groupBy(F.col("name").alias("n3")).agg(F.countDistinct("key").alias("k"), F.min("key").alias("unique")).where("k = 1").drop("k")
    j = r.join(here, (F.col("path") == F.col("p1")) & (F.col("head") == F.col("n1")), "left").join(via, (F.col("path") == F.col("p2")) & (F.col("head") == F.col("n2")), "left").join(only, F.col("head") == F.col("n3"), "left")
    how = F.when(F.col("own").isNotNull(), "same_file").when(F.col("imported").isNotNull(), "import").when(F.col("unique").isNotNull(), "unique")
    return j.select(*refs.columns, F.coalesce("own", "imported", "unique").alias("target"), how.alias("how"))


def cluster_members(clusters: DataFrame, symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """cluster, symbols and files (how many), untested and substantial: whether some symbol has no test, and whether some is more than cosmetic. clusters: cluster, symbol; symbols: symbol, path, cosmetic; tested: symbol."""
    t = tested.select(F.col("symbol").alias("t")).distinct()
    j = clusters.join(symbols, "symbol").join(t, F.col("symbol") == F.col("t"), "left")
    return j.groupBy("cluster").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("path").alias("files"), F.bool_or(F.col("t").isNull() & ~F.col("cosmetic")).alias("untested"), F.bool_or(~F.col("cosmetic")).alias("substantial"))


def upsert_units(units: DataFrame, stored: DataFrame) -> DataFrame:
    """Units (unit, content_hash, ...) that must be embedded: new ones and those whose stored hash differs."""
    return units.join(stored.select(F.col("unit").alias("s_unit"), F.col("content_hash").alias("s_hash")), (F.col("unit") == F.col("s_unit")) & (F.col("content_hash") == F.col("s_hash")), "left_anti")


def from_arrays(rows: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Rows of parallel arrays, as bulk inserts bring them, as one row an entry; shorter arrays give nulls."""
    return rows.select(*keys, F.inline(F.arrays_zip(*arrays)))


def stored_edges(edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges as stored (kind as its number), and how many of each unknown kind were left out."""
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    return edges.withColumn("kind_no", number).where("kind_no >= 0"), edges.where(number < 0).groupBy("kind").agg(F.count("*").alias("dropped"))


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no blanks and six decimals for numbers that are not whole; null if it is none."""

    def write(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(write, v)) + "]"
        return f"{v:.6f}" if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else write(json.loads(t))
        except ValueError:
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(one, na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text)
