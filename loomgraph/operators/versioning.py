"""Snapshots as a base and deltas, latest wins; decisions about chains; matching of renamed symbols."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.numbers import jaccard
from loomgraph.operators.common import cut

# Legal steps of a snapshot's status.
SNAPSHOT_STEPS = (("pending", "indexing"), ("pending", "failed"), ("indexing", "persisting"), ("indexing", "failed"), ("persisting", "ready"), ("persisting", "failed"), ("ready", "inconsistent"))
MAX_CHAIN_DEPTH, MAX_CHURN = 20, 0.10


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key by the order (columns, rising). One aggregation, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("__r"))).alias("b"))
    return best.select(*keys, *(F.col(f"b.__r.{c}").alias(c) for c in rest))


def at_snapshot(chain: DataFrame, keys: Sequence[str], pos: str = "chain_pos", removed: str = "removed", floor: Column | None = None) -> DataFrame:
    """Rows that hold at the chain's end: latest by position first, then tombstones go, then a floor applies."""
    live = latest(chain, keys, F.col(pos)).where(~F.col(removed))
    return live if floor is None else live.where(floor)


def overlay(base: DataFrame, added: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without keys that were added anew or removed, and what was added."""
    shadow = added.select(*keys).unionByName(gone.select(*keys)).distinct()
    return base.join(shadow, list(keys), "left_anti").unionByName(added)


def flatten(base: DataFrame, deltas: Sequence[tuple[DataFrame, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """A base and (added, removed) deltas, oldest first, as one table: removals come before additions in each."""
    out = base
    for added, gone in deltas:
        out = overlay(out, added, gone, keys)
    return out


def page(rows: DataFrame, order: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The next rows after a key, and in `more` whether others follow."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(a).cast(rows.schema[o].dataType).alias(o) for o, a in zip(order, after, strict=True))))
    some = rows.orderBy(*order).limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    return some.withColumn("more", F.max("__n").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def churn(added: Column, removed: Column, base_edges: Column) -> Column:
    """Changed over base edges as an aggregate; 0 without change, infinite without a base."""
    changed = F.sum(added + removed)
    return F.when(changed == 0, 0.0).when(F.max(base_edges) == 0, float("inf")).otherwise(changed / F.max(base_edges))


def compaction(depth: Column, ratio: Column) -> Column:
    """keep, chain_depth or churn; both limits must be passed."""
    return F.when(depth > MAX_CHAIN_DEPTH, "chain_depth").when((depth > 0) & (ratio > MAX_CHURN), "churn").otherwise("keep")


def rebuild(reasons: Column, depth: Column, ratio: Column) -> Column:
    """incremental, compact_then_incremental, relink or reparse, from an array of reasons; here limits hold when reached."""
    return (
        F.when((F.size(reasons) == 0) & ((depth >= MAX_CHAIN_DEPTH) | (ratio >= MAX_CHURN)), "compact_then_incremental")
        .when(F.size(reasons) == 0, "incremental")
        .when(F.forall(reasons, lambda r: r == "linker_version_changed"), "relink")
        .otherwise("reparse")
    )


def legal_step(before: Column, after: Column, steps: Sequence[tuple[str, str]] = SNAPSHOT_STEPS) -> Column:
    return F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in steps))


def affected_names(before: DataFrame, added: DataFrame, removed: DataFrame, fanout: int = 3) -> DataFrame:
    """name, before, after, crossed: names whose candidates changed, by rows (name, key); crossed: past 1/2 or the fan-out."""
    names = added.select("name").unionByName(removed.select("name")).distinct()
    old = before.join(names, "name", "left_semi").select("name", "key").distinct()
    new = overlay(old, added.select("name", "key").distinct(), removed.select("name", "key"), ["name", "key"]).join(removed.select("name", "key"), ["name", "key"], "left_anti")
    n = lambda df, c: df.groupBy("name").agg(F.sort_array(F.collect_set("key")).alias(c))
    none = F.array().cast("array<string>")
    j = names.join(n(old, "b"), "name", "left").join(n(new, "a"), "name", "left").withColumns({"b": F.coalesce("b", none), "a": F.coalesce("a", none)}).where("a <> b")
    x, y = F.size("b"), F.size("a")
    return j.select("name", x.alias("before"), y.alias("after"), (((x <= 1) & (y >= 2)) | ((x >= 2) & (y <= 1)) | ((x <= fanout) != (y <= fanout))).alias("crossed"))


def symbol_diff(base: DataFrame, head: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """key, change (added, removed, modified, unchanged) and which hashes differ."""
    from loomgraph.operators.graph import compare

    names = {"only_a": "removed", "only_b": "added", "changed": "modified", "same": "unchanged"}
    out = compare(base, head, [key], hashes)
    return out.select(key, F.element_at(F.create_map(*(F.lit(v) for kv in names.items() for v in kv)), F.col("status")).alias("change"), F.col("fields").alias("flags"))


def multiset_diff(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, removed and added: how many copies a side has more."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    j = n(base, "x").join(n(head, "y"), list(keys), "full_outer").na.fill(0, ["x", "y"]).where("x <> y")
    return j.select(*keys, F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("removed"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("added"))


def rename_candidates(removed: DataFrame, added: DataFrame, min_exact: int = 6, min_fuzzy: int = 12, least: float = 0.8) -> DataFrame:
    """a, b, rule, similarity. Symbols: key, kind, name, module, body, signature, tokens, shingles. Met by equal body, equal signature or one of the four least shingles, never pair by pair."""
    removed, added = cut(removed), cut(added)
    keys = F.concat(F.array(F.concat(F.lit("b"), "body"), F.concat(F.lit("s"), "signature")), F.transform(F.slice(F.sort_array("shingles"), 1, 4), lambda x: F.concat(F.lit("h"), x.cast("string"))))
    block = lambda df, k: df.select(F.col("key").alias(k), "kind", F.explode(F.array_distinct(keys)).alias("block"))
    met = block(removed, "k1").join(block(added, "k2"), ["kind", "block"]).select("k1", "k2").distinct()
    met = met.join(removed.select(F.struct(*removed.columns).alias("p")), F.col("k1") == F.col("p.key")).join(added.select(F.struct(*added.columns).alias("q")), F.col("k2") == F.col("q.key"))
    j, n = jaccard(F.col("p.shingles"), F.col("q.shingles")), F.least("p.tokens", "q.tokens")
    exact = (F.col("p.body") == F.col("q.body")) & (n >= min_exact)
    moved = (F.col("p.signature") == F.col("q.signature")) & (F.col("p.name") == F.col("q.name")) & (F.col("p.module") != F.col("q.module")) & (n >= min_fuzzy)
    rule = F.when(exact, "exact_body").when(moved, "signature_and_name").when((j >= least) & (n >= min_fuzzy), "token_similarity")
    return met.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"), rule.alias("rule"), F.when(exact, 1.0).when(moved, F.greatest(j, F.lit(least))).otherwise(j).alias("similarity")).where("rule is not null")


def assign(pairs: DataFrame, rounds: int = 32) -> DataFrame:
    """One-to-one pairs a, b (neither null) by falling similarity, then a, then b: in each round those best on both sides are taken. Sides whose best is tied are left out first.

    Rounds take what is best at once; what a long chain leaves after `rounds` is folded in order, one task a component, so no pair is lost.
    """
    pairs = cut(pairs.where("a is not null and b is not null"))
    tied = lambda k: pairs.withColumn("r", F.rank().over(Window.partitionBy(k).orderBy(F.desc("similarity")))).where("r = 1").groupBy(k).count().where("count > 1").select(k)
    left = cut(pairs.join(tied("a"), "a", "left_anti").join(tied("b"), "b", "left_anti"))
    taken = None
    for _ in range(rounds):
        order = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("similarity"), "a", "b"))
        best = cut(left.withColumn("x", order("a")).withColumn("y", order("b")).where("x = 1 and y = 1").drop("x", "y"))
        taken = best if taken is None else taken.unionByName(best)
        left = cut(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"))
        if not left.limit(1).count():
            return taken
    rest = _assign_in_order(left.select(*pairs.columns))
    return rest if taken is None else taken.select(*pairs.columns).unionByName(rest)


def _assign_in_order(left: DataFrame) -> DataFrame:
    """The pairs that are taken one after the other, each component of pairs by itself."""
    from loomgraph.operators.graph import components

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        a, b, keep = set(), set(), []
        df = df.sort_values("__o")
        for x, y in df[["a", "b"]].itertuples(index=False, name=None):
            keep.append(x not in a and y not in b)
            if keep[-1]:
                a.add(x)
                b.add(y)
        return df[keep][names]

    names = left.columns
    side = lambda k: F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))
    group = components(left.select(side("a").alias("a"), side("b").alias("b")))
    rows = left.withColumn("__k", side("a")).join(group, F.col("__k") == F.col("node_key"))
    rows = rows.withColumn("__o", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("similarity"), "a", "b")))
    return rows.select("component", "__o", *names).groupBy("component").applyInPandas(fold, left.schema)


def transition(name_a: Column, name_b: Column, module_a: Column, module_b: Column) -> Column:
    r, m = name_a != name_b, module_a != module_b
    return F.when(r & m, "renamed_and_moved").when(r, "renamed").when(m, "moved").otherwise("same")


def merge_ids(existing: Column, add: Column, cap: int, pinned: Column | None = None) -> Column:
    """add put last; beyond cap the oldest ids go that are not pinned."""
    kept = F.filter(existing, lambda x: x != add)
    over = F.size(kept) + 1 - max(cap, 1)
    free = kept if pinned is None else F.filter(kept, lambda x: ~F.array_contains(pinned, x))
    gone = F.slice(free, F.lit(1), F.greatest(over, F.lit(0)))
    return F.concat(F.filter(kept, lambda x: ~F.array_contains(gone, x)), F.array(add))


def rereview(current: DataFrame, previous: DataFrame, covered: DataFrame, key: str = "identity") -> DataFrame:
    """identity, status: persisting, new, fixed (covered now), not_reevaluated."""
    c, p = current.select(key).distinct().withColumn("c", F.lit(1)), previous.select(key).distinct().withColumn("p", F.lit(1))
    j = c.join(p, key, "full_outer").join(covered.select(key).distinct().withColumn("v", F.lit(1)), key, "left")
    return j.select(key, F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), "persisting").when(F.col("c").isNotNull(), "new").when(F.col("v").isNotNull(), "fixed").otherwise("not_reevaluated").alias("status"))
