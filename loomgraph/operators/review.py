"""Risk, ranking, selection, merging and evaluation of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import numbers as N
from loomgraph.operators.graph import components

# Fixed values of scoring.
MAX_CONTRIBUTION, AMPLIFIER, DAMPENING, MANY_FILES = 0.95, 1.15, 0.3, 50
AMPLIFIED = ("authorization", "authentication", "validation")
LEVELS = ("low", "medium", "high", "critical")
LEAST_SCORE = (0.0, 0.25, 0.5, 0.75)
# Rule, category, weight, floor level.
RULES = (
    ("path.configured", "authentication", 0.8, None), ("path.auth", "authentication", 0.5, None), ("path.migrations", "database_migrations", 0.55, None), ("path.payments", "payments", 0.65, None),
    ("path.infra", "dependency_updates", 0.3, None), ("dep.added", "dependency_updates", 0.3, None), ("dep.major_bump", "dependency_updates", 0.45, None), ("dep.prerelease", "dependency_updates", 0.4, None),
    ("dep.removed", "dependency_updates", 0.25, None), ("dep.lock_drift", "dependency_updates", 0.2, None), ("migration.added", "database_migrations", 0.55, None), ("migration.destructive", "database_migrations", 0.75, "high"),
    ("migration.edited_existing", "database_migrations", 0.7, None), ("schema.entity_changed", "schema_changes", 0.5, None), ("secrets.literal_added", "secrets", 0.9, "critical"), ("secrets.env_file", "secrets", 0.8, None),
    ("authz.call_removed", "authorization", 0.85, "high"), ("authz.direct_role_check", "authorization", 0.6, None), ("authz.guard_removed", "authorization", 0.85, "high"), ("authz.guard_added", "authorization", 0.4, None),
    ("authz.logic_changed", "authorization", 0.7, None), ("validation.removed", "validation", 0.65, None), ("db.write_changed", "schema_changes", 0.4, None), ("db.write_changed_in_tx", "transaction_boundaries", 0.45, None),
    ("tx.boundary_changed", "transaction_boundaries", 0.6, None), ("api.breaking_change", "public_api_contracts", 0.6, None), ("api.additive_change", "public_api_contracts", 0.35, None), ("async.floating_promise", "concurrency", 0.5, None),
    ("endpoint.reachable", "public_api_contracts", 0.3, None), ("queue.produce_changed", "queues", 0.45, None), ("queue.consume_changed", "background_jobs", 0.45, None), ("external.call_added", "external_network_calls", 0.4, None),
    ("fs.access_changed", "filesystem_access", 0.4, None), ("crypto.changed", "cryptography", 0.6, None), ("auth.jwt_verify_removed", "authentication", 0.8, "high"), ("auth.authn_changed", "authentication", 0.7, None),
    ("serialization.changed", "serialization", 0.4, None), ("payments.changed", "payments", 0.65, None), ("concurrency.shared_state", "concurrency", 0.45, None),
)


def rule_table(spark) -> DataFrame:
    """The rules, a few rows that joins send to all tasks, so that no rule's signals meet in one."""
    return F.broadcast(spark.createDataFrame(list(RULES), "rule string, category string, weight double, floor string"))


def level_number(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def dedup_signals(signals: DataFrame) -> DataFrame:
    """One signal a rule and subject: most confidence (whose explanation stays), most weight, highest floor."""
    out = signals.groupBy("rule", "subject").agg(F.max(F.struct("confidence", "explanation")).alias("b"), F.max("weight").alias("weight"), F.max(level_number(F.col("floor"))).alias("f"), F.first("category").alias("category"))
    return out.select("rule", "subject", "category", "b.confidence", "b.explanation", "weight", F.get(F.array(*map(F.lit, LEVELS)), F.col("f")).alias("floor"))


def contributions(signals: DataFrame) -> DataFrame:
    """signals with contribution: weight, confidence, amplifier of reachable subjects, dampening of low-risk path signals (low_risk, from_path)."""
    reach = signals.where("rule = 'endpoint.reachable'").select(F.col("subject").alias("__s")).distinct().withColumn("__r", F.lit(True))
    s = signals.join(reach, F.col("subject") == F.col("__s"), "left")
    amp = F.when(F.col("__r") & F.col("category").isin(*AMPLIFIED), AMPLIFIER).otherwise(1.0)
    damp = F.when(F.col("low_risk") & F.col("from_path"), DAMPENING).otherwise(1.0)
    return s.withColumn("contribution", F.round(F.least(F.greatest(F.col("weight") * F.col("confidence") * amp * damp, F.lit(0.0)), F.lit(MAX_CONTRIBUTION)), 4)).drop("__s", "__r")


def risk_scores(signals: DataFrame, subject: str = "subject", many_files: Column | None = None, digits: int = 4) -> DataFrame:
    """subject, score, level: most per category, noisy-OR over categories, the highest floor as least level."""
    per = signals.groupBy(subject, "category").agg(F.max("contribution").alias("c"), F.max(level_number(F.col("floor"))).alias("f"))
    s = per.groupBy(subject).agg(F.collect_list("c").alias("cs"), F.max("f").alias("f")).withColumn("raw", N.noisy_or(F.sort_array("cs")))
    if many_files is not None:
        s = s.withColumn("raw", F.when(many_files, 1 - (1 - F.col("raw")) * 0.9).otherwise(F.col("raw")))
    own = level_number(N.risk_level(F.col("raw")))
    level = F.greatest(own, F.coalesce("f", F.lit(-1)))
    floor = F.when(F.col("f").isNotNull(), F.get(F.array(*map(F.lit, LEAST_SCORE)), level)).otherwise(0.0)
    return s.select(subject, F.round(F.greatest("raw", floor), digits).alias("score"), F.get(F.array(*map(F.lit, LEVELS)), level).alias("level"))


def priority(severity: Column, confidence: Column, callers: Column, exposure: Column, security: Column, data: Column, test_gap: Column, change_risk: Column) -> Column:
    sev = F.get(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))), F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), severity).cast("int") - 1)
    blast = F.least(F.log2(1 + F.least(callers, F.lit(1_000_000))) / F.log2(F.lit(33.0)), F.lit(1.0))
    raw = 0.35 * sev + 0.20 * N.unit(confidence) + 0.15 * F.greatest(N.unit(security), N.unit(data)) + 0.10 * N.unit(exposure) + 0.08 * N.unit(change_risk) + 0.07 * blast + 0.05 * N.unit(test_gap)
    return F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 4)


SIGNALS = ("structural", "proximity", "execution_path", "changed_code", "test", "api", "config", "semantic", "historical", "risk")
# Weights of the signals by reviewer.
CONTEXT_WEIGHTS = {
    "correctness": (0.25, 0.20, 0.12, 0.10, 0.08, 0.06, 0.05, 0.06, 0.0, 0.08), "security": (0.20, 0.15, 0.25, 0.05, 0.03, 0.12, 0.05, 0.03, 0.0, 0.12),
    "test": (0.15, 0.15, 0.05, 0.10, 0.35, 0.05, 0.03, 0.07, 0.0, 0.05), "architecture": (0.30, 0.10, 0.05, 0.05, 0.0, 0.15, 0.10, 0.15, 0.0, 0.10),
    "performance": (0.25, 0.20, 0.15, 0.10, 0.02, 0.05, 0.08, 0.05, 0.0, 0.10), "maintainability": (0.25, 0.20, 0.0, 0.20, 0.05, 0.0, 0.05, 0.20, 0.0, 0.05),
}


def context_score(reviewer: Column, confidence: Column, weak: Column, prefix: str = "") -> Column:
    """Weighted sum of the ten signal columns, times 0.5 + 0.5 confidence, times 0.7 if weak, to 6 places."""
    w = F.element_at(F.create_map(*(x for k, v in CONTEXT_WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), reviewer)
    total = sum((F.get(w, i) * N.unit(F.col(prefix + s)) for i, s in enumerate(SIGNALS)), F.lit(0.0))
    return F.round(total * (0.5 + 0.5 * N.unit(confidence)) * F.when(weak, 0.7).otherwise(1.0), 6)


def context_gate(distance: Column, score: Column, strong: Column, on_path: Column, kind: Column) -> Column:
    """pass, below or distance; strong: how many signals but proximity are 0.5 or more."""
    return (
        F.when(distance == 0, "pass")
        .when(distance == 1, F.when(score >= 0.20, "pass").otherwise("below"))
        .when(distance == 2, F.when(score >= 0.35, "pass").otherwise("below"))
        .when(distance >= 4, F.when(on_path | kind.isin("test", "api_endpoint"), "pass").otherwise("distance"))
        .otherwise(F.when((score >= 0.5) & (strong >= 2), "pass").when(score < 0.5, "below").otherwise("distance"))
    )


# Pinned items come by kind in this order, other kinds after them.
PINNED_KINDS = ("changed_symbol", "class_signature")


def select_greedy(items: DataFrame, keys: Sequence[str], budget: int, caps: dict[str, int]) -> DataFrame:
    """keys, item, taken (tokens or null), reason of items (keys, item, score, tokens, cheaper_tokens, pinned, category and, if given, kind). Pinned items come first, by kind, falling score and id, then the rest by falling score per token, falling score and id; items that would pass a category's cap or the budget are left out and take nothing of either; a cheaper form is taken where only it fits, if the item is pinned or scores 0.5.

    One group is one reviewer's package for one cluster, whose size the caps of candidates bound; it is an ordered array
    that is folded as a whole, where it is.
    """

    names = list(caps)
    at = F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int") if names else F.lit(0)

    def step(now, r):
        # What an item takes; -1: no room for it, -2: its category's cap is reached.
        room, left = now["room"], now["left"]
        cheap = r["cheaper_tokens"].isNotNull() & (r["pinned"] | (r["score"] >= 0.5)) & (r["cheaper_tokens"] <= room)
        cost = F.when(r["tokens"] <= room, r["tokens"]).when(cheap, r["cheaper_tokens"]).otherwise(-1).cast("bigint")
        took = F.when((r["at"] > 0) & (F.get(left, r["at"] - 1) <= 0), F.lit(-2).cast("bigint")).otherwise(cost)
        rest = lambda x: F.transform(left, lambda n, i: n - ((x >= 0) & (i == r["at"] - 1)).cast("int"))
        return F.get(F.transform(F.array(took), lambda x: F.struct((room - F.greatest(x, F.lit(0))).alias("room"), rest(x).alias("left"), F.concat(now["out"], F.array(x)).alias("out"))), F.lit(0))

    first_state = F.struct(F.lit(budget).cast("bigint").alias("room"), F.array(*(F.lit(caps[n]).cast("int") for n in names)).cast("array<int>").alias("left"), F.array().cast("array<bigint>").alias("out"))
    rank = F.array_position(F.array(*map(F.lit, PINNED_KINDS)), F.col("kind") if "kind" in items.columns else F.lit(""))
    first = F.when(F.col("pinned"), F.when(rank > 0, rank).otherwise(len(PINNED_KINDS) + 1)).otherwise(len(PINNED_KINDS) + 2)
    ratio = F.when(F.col("pinned"), 0.0).otherwise(-F.col("score") / F.greatest("tokens", F.lit(1)))
    order = F.struct(first.alias("first"), ratio.alias("r"), (-F.col("score")).alias("s"), "item", "tokens", "cheaper_tokens", "pinned", "score", F.coalesce(at, F.lit(0)).alias("at"))
    g = items.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("g"))
    x = g.select(*keys, F.explode(F.arrays_zip(F.col("g.item").alias("item"), F.aggregate("g", first_state, step, lambda s: s["out"]).alias("took"))).alias("x"))
    return x.select("x.item", F.when(F.col("x.took") >= 0, F.col("x.took")).alias("taken"), F.when(F.col("x.took") >= 0, "selected").when(F.col("x.took") == -2, "count").otherwise("tokens").alias("reason"), *keys)


def _sorted(df: DataFrame) -> DataFrame:
    """The side of a join that is met by sorting, never sent to the driver: arrays of like items exchange as a few bytes, by which Spark would judge them small, and are many times that in memory."""
    return df.hint("merge")


def similar_sets(sets: DataFrame, keys: Sequence[str], col: str, least: float) -> DataFrame:
    """keys, x, y: unlike sets (distinct rows of keys and col, a sorted array) of equal keys with a Jaccard similarity of `least` or more. They meet by one of their rarest elements: of n, all but the last ceil(least * n) - 1."""
    sets = sets.select(*keys, col)
    each = sets.withColumn("__t", F.explode(col))
    rare = each.join(_sorted(each.groupBy(*keys, "__t").agg(F.count("*").alias("__n"))), [*keys, "__t"]).groupBy(*keys, col).agg(F.sort_array(F.collect_list(F.struct("__n", "__t"))).alias("__p"))
    prefix = F.slice("__p", F.lit(1), F.size("__p") - F.ceil(F.size("__p") * least - 1e-9).cast("int") + 1)
    met = rare.select(*keys, col, F.explode(F.transform(prefix, lambda e: e["__t"])).alias("__t"))
    both = met.withColumnRenamed(col, "x").join(_sorted(met.withColumnRenamed(col, "y")), [*keys, "__t"])
    return both.where((F.col("x") < F.col("y")) & (N.jaccard(F.col("x"), F.col("y")) >= least)).select(*keys, "x", "y").distinct()


def merge_groups(items: DataFrame) -> DataFrame:
    """primary, member: findings (id, fingerprint, symbol, predicate, ranges, start, end, tokens, confidence, severity, evidence; start <= end) joined by equal fingerprint, or by symbol and overlap; groups of two and more.

    Only the components of the links count, so no symbol makes all its pairs. Findings alike in what a rule reads are a star
    to their least id, and the rule is asked of unlike ones: of sets of lines, and of islands, the overlapping anchors of
    one set of tokens, which meet where any of their anchors do.
    """
    from loomgraph.operators.intervals import cover

    def star(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        lead = rows.groupBy(*keys).agg(F.min("id").alias("a"))
        return lead, rows.join(_sorted(lead), list(keys)).where("id <> a").select("a", F.col("id").alias("b"))

    same = star(items.where("fingerprint is not null"), ["fingerprint"])[1]
    lines = items.withColumn("lines", F.sort_array(cover(F.col("ranges")))).where("symbol is not null and predicate is not null and size(lines) > 0").select("id", "symbol", "predicate", "lines")
    by = ["symbol", "predicate"]
    lead, alike = star(lines, [*by, "lines"])
    near = similar_sets(lead, by, "lines", 0.5)
    near = near.join(_sorted(lead.withColumnsRenamed({"lines": "x"})), [*by, "x"]).join(_sorted(lead.withColumnsRenamed({"lines": "y", "a": "b"})), [*by, "y"]).select("a", "b")

    said = items.where("symbol is not null and start is not null and end is not null and tokens is not null").select("id", "symbol", F.sort_array(F.array_distinct("tokens")).alias("said"), "start", "end")
    anchors, equal = star(said, ["symbol", "said", "start", "end"])
    w = Window.partitionBy("symbol", "said").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    anchors = anchors.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    islands = anchors.groupBy("symbol", "said", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("a").alias("a"))
    chained = anchors.select("symbol", "said", "island", F.col("a").alias("b")).join(_sorted(islands), ["symbol", "said", "island"]).where("a <> b").select("a", "b")
    x, y = (_sorted(islands.select("symbol", F.col("said").alias(k), F.struct("start", "end", "a").alias(f"i{k}"))) for k in "xy")
    claims = similar_sets(islands.select("symbol", "said").distinct(), ["symbol"], "said", 0.6).join(x, ["symbol", "x"]).join(y, ["symbol", "y"])
    claims = claims.where("ix.start <= iy.end and iy.start <= ix.end").select("ix.a", F.col("iy.a").alias("b"))
    links = same.unionByName(alike).unionByName(near).unionByName(equal).unionByName(chained).unionByName(claims)
    member = components(links).join(_sorted(items.select("id", "confidence", "severity", "evidence")), F.col("node_key") == F.col("id"))
    best = member.groupBy("component").agg(F.min(F.struct(-F.col("confidence"), -F.col("severity"), -F.col("evidence"), F.col("id").alias("p"))).alias("b"))
    return member.join(_sorted(best), "component").select(F.col("b.p").alias("primary"), F.col("id").alias("member"))


def evaluation(rows: DataFrame) -> DataFrame:
    """Precision, recall and rates with intervals from published, correct, expected and found flags; empty denominators are null."""
    m = rows.agg(*(F.count_if(F.col(c)).alias(c) for c in ("tp", "fp", "dup", "expected", "hit")), F.count("*").alias("n"))
    ratio = lambda a, b: F.try_divide(a, b)
    tp, fp = F.col("tp"), F.col("fp")
    return m.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fp + F.col("dup")).alias("precision_strict"), ratio(F.col("hit"), F.col("expected")).alias("recall"), ratio(fp, F.col("n")).alias("fp_rate"), F.round(N.wilson(tp, tp + fp)["low"], 9).alias("precision_low"), F.round(N.wilson(tp, tp + fp)["high"], 9).alias("precision_high"))


def conventions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, consistency, modules, confidence, enforceable from rows conforms, module."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("conforms").cast("int")).alias("consistency"), F.countDistinct("module").alias("modules"))
    conf = F.col("consistency") * N.sample_factor(F.col("n")) * N.spread_factor(F.col("modules"))
    return g.withColumn("confidence", F.round(conf, 6)).withColumn("enforceable", (F.col("confidence") >= 0.9) & (F.col("n") >= 10))


def consecutive_links(members: DataFrame, over: str, key: str) -> DataFrame:
    """a, b: neighbours in order of key among the members of a group; each group is a chain, not all its pairs."""
    nxt = F.lead(key).over(Window.partitionBy(over).orderBy(key))
    return members.select(over, key).distinct().select(F.col(key).alias("a"), nxt.alias("b")).where("b is not null")


def cluster_key(members: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(members), ","), 256)


def name_join(refs: DataFrame, names: DataFrame, fanout: int = 3) -> DataFrame:
    """ref, target, outcome, confidence, candidates: unique (600), ambiguous up to the fan-out (300, all targets), else unresolved. Names are counted before the join, so common names do not multiply."""
    n = names.groupBy("name").agg(F.count_distinct("key").alias("candidates"))
    r = refs.join(n, "name", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("bigint")))
    hit = r.where((F.col("candidates") >= 1) & (F.col("candidates") <= fanout)).join(names.select("name", "key").distinct(), "name")
    one = F.col("candidates") == 1
    found = hit.select("ref", F.col("key").alias("target"), F.when(one, "unique").otherwise("ambiguous").alias("outcome"), F.when(one, 600).otherwise(300).alias("confidence"), "candidates")
    rest = r.where((F.col("candidates") == 0) | (F.col("candidates") > fanout)).select("ref", F.lit(None).cast("string").alias("target"), F.lit("unresolved").alias("outcome"), F.lit(0).alias("confidence"), "candidates")
    return found.unionByName(rest)


def overrides(members: DataFrame, supers: DataFrame) -> DataFrame:
    """sub, super members of equal name over rows owner, name, key and owner, parent."""
    sub = members.join(supers, "owner")
    return sub.alias("x").join(members.alias("y"), (F.col("x.parent") == F.col("y.owner")) & (F.col("x.name") == F.col("y.name"))).select(F.col("x.key").alias("sub"), F.col("y.key").alias("super"))


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """parent, child: directories over each path, each edge once."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.where(F.length(path) > 0).select(F.explode(F.transform(up, lambda p, i: F.struct(F.when(i > 0, F.get(up, i - 1)).otherwise("").alias("parent"), p.alias("child")))).alias("e")).select("e.*").distinct()


def resource_partners(access: DataFrame, cap: int = 5) -> DataFrame:
    """member, resource, other: up to `cap` other members of a resource, in order; found by rank, so a resource with many members makes no more than cap + 1 rows a member."""
    w = Window.partitionBy("resource").orderBy("member")
    first = access.select("resource", "member").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap + 1)
    j = access.select("resource", "member").distinct().alias("x").join(first.alias("y"), (F.col("x.resource") == F.col("y.resource")) & (F.col("x.member") != F.col("y.member")))
    k = F.row_number().over(Window.partitionBy("x.resource", "x.member").orderBy("y.member"))
    return j.withColumn("k", k).where(F.col("k") <= cap).select("x.resource", "x.member", F.col("y.member").alias("other"))
