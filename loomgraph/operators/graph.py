"""A property graph as two DataFrames: nodes (node_key, kind, name, path, ...) and edges (source, kind, target, confidence, ...).

Every result has a total order, given by key columns; confidence is in permille.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.common import cut, ranked, small
from loomgraph.operators.schema import kind_number

MAX_DEPTH, MAX_NODES, SUBGRAPH_NODES = 16, 1_000_000, 500
# Keys that are sent to all executors at most.
FEW_KEYS = 1 << 17


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """edges with `at` (where one stands) and `other`; both: each edge from either end."""
    out = edges.withColumns({"at": F.col("source"), "other": F.col("target")})
    into = edges.withColumns({"at": F.col("target"), "other": F.col("source")})
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def at_keys(directed_edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Directed edges at keys (node_key); few keys are sent to where edges are read, before these are joined, merged or shuffled."""
    k = keys.select(F.col("node_key").alias("__k")).distinct()
    return directed_edges.join(small(k, FEW_KEYS), F.col("at") == F.col("__k"), "left_semi")


def degree(edges: DataFrame, direction: str = "both") -> DataFrame:
    """node_key, degree; a loop counts once for either end."""
    return directed(edges, direction).groupBy(F.col("at").alias("node_key")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, keys: DataFrame, direction: str = "both") -> DataFrame:
    """node_key, neighbour, distinct; with both, source and target of each edge count, so the node itself appears."""
    hit = at_keys(directed(edges, direction), keys)
    out = hit.select(F.col("at").alias("node_key"), F.col("other").alias("neighbour"))
    if direction == "both":
        out = out.unionByName(hit.select(F.col("at").alias("node_key"), F.col("at").alias("neighbour")))
    return out.distinct()


def adjacent(edges: DataFrame, keys: DataFrame, direction: str) -> DataFrame:
    """Edges at keys with their rank in canonical order (kind number, other end)."""
    e = at_keys(directed(edges, direction), keys)
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(kind_number(F.col("kind")), "other")))


def kind_histogram(edges: DataFrame) -> DataFrame:
    """node_key, side, kind, bucket (confidence in tenths, 9 at most), n."""
    e = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node_key"), F.lit("out").alias("side")), F.struct(F.col("target").alias("node_key"), F.lit("in").alias("side")))).alias("x"), "kind", F.least(F.floor(F.col("confidence") / 100), F.lit(9)).cast("int").alias("bucket"))
    return e.groupBy("x.node_key", "x.side", "kind", "bucket").agg(F.count("*").alias("n"))


def merge_occurrences(edges: DataFrame) -> DataFrame:
    """One edge an identity (source, kind, target): most confidence (then least resolved_by), flags OR, occurrences summed, first place."""
    best = F.max(F.struct("confidence", -F.col("resolved_by")))
    e = edges.groupBy("source", "kind", "target").agg(best.alias("b"), F.bit_or("flags").alias("flags"), F.sum("occurrences").alias("occurrences"), F.min(F.struct("path", "line")).alias("at"))
    return e.select("source", "kind", "target", F.col("b.confidence").alias("confidence"), (-F.col("b.col2")).alias("resolved_by"), "flags", "occurrences", "at.path", "at.line")


def bfs(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int = 2, max_nodes: int | None = 10_000, edge_budget: int | None = None, until: str | None = None) -> tuple[DataFrame, bool]:
    """Nodes by first discovery: node_key, depth, idx (order of discovery), parent, kind, confidence (least along the way); and whether it was cut short.

    A level is one join; within it, earlier discovered parents, then kinds, then keys come first. The visited set stays
    distributed; what the driver sees are counts. Seeds count as nodes. Without max_nodes (null) all nodes within the depth
    are found; the search ends with the level that finds `until`.
    """
    e = directed(edges, direction).select("at", "other", "kind", "confidence")
    most = max_nodes if max_nodes is not None else 1 << 60
    first = ranked(seeds.select("node_key").distinct(), "node_key", name="idx").where(F.col("idx") <= most)
    visited = cut(first.select("node_key", F.lit(0).alias("depth"), "idx", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(1000).alias("confidence")))
    level, total, left, short = visited, visited.count(), edge_budget or 50 * most, False
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        steps = level.select(F.col("node_key").alias("from"), F.col("idx").alias("from_idx"), F.col("confidence").alias("so_far")).join(at_keys(e, level), F.col("from") == F.col("at"))
        new = steps.join(visited.select(F.col("node_key").alias("__v")), F.col("other") == F.col("__v"), "left_anti")
        by = F.struct("from_idx", kind_number(F.col("kind")).alias("k"), (-F.col("confidence")).alias("c"))
        one = new.groupBy("other").agg(F.min_by(F.struct("from", "from_idx", "kind", "so_far", "confidence"), by).alias("s")).select("other", "s.*")
        found = ranked(one, F.col("from_idx"), kind_number(F.col("kind")), F.col("other")).where(F.col("n") <= most - total + 1)
        found = cut(found.select(F.col("other").alias("node_key"), F.lit(depth).alias("depth"), (F.col("n") + total).alias("idx"), F.col("from").alias("parent"), "kind", F.least("so_far", "confidence").alias("confidence")))
        n = found.count()
        left -= n
        if n == 0:
            break
        if total + n > most or left < 0:
            found, short = found.where(F.col("idx") <= most), True
        total += min(n, most - total)
        visited = cut(visited.unionByName(found))
        level = found
        if short or (until is not None and found.where(F.col("node_key") == until).limit(1).count()):
            break
    return visited, short


def shortest_path(edges: DataFrame, source: str, target: str, direction: str = "out", max_depth: int = 6) -> DataFrame:
    """Steps of a path of fewest hops: step, from, kind, to, confidence; no rows if there is none or the ends are one.

    A search back from the target finds what can lie on such a path; only edges among these nodes are searched from the source.
    """
    spark = edges.sparkSession
    if direction == "both":
        raise ValueError("a path has a direction")
    none = spark.createDataFrame([], "step int, from string, kind string, to string, confidence int")
    if source == target:
        return none
    one = lambda k: spark.createDataFrame([(k,)], "node_key string")
    near, _ = bfs(edges, one(target), "in" if direction == "out" else "out", max_depth, max_nodes=None, until=source)
    ends = small(near.select(F.col("node_key").alias("__n")), FEW_KEYS)
    edges = edges.join(ends, F.col("source") == F.col("__n"), "left_semi").join(ends, F.col("target") == F.col("__n"), "left_semi")
    seen, _ = bfs(edges, one(source), direction, max_depth, max_nodes=None, until=target)
    conf = directed(edges, direction).groupBy("at", "other", "kind").agg(F.max("confidence").alias("c"))
    walk = spark.createDataFrame([(target, 0)], "at_node string, back int")
    steps = None
    row = seen.where(F.col("node_key") == target).select("depth").head()
    for k in range(row[0] if row else 0):
        step = cut(F.broadcast(walk).join(seen, F.col("at_node") == F.col("node_key")).select(F.lit(row[0] - k).alias("step"), F.col("parent").alias("from"), "kind", F.col("node_key").alias("to")))
        steps = step if steps is None else steps.unionByName(step)
        walk = step.select(F.col("from").alias("at_node"), F.lit(k + 1).alias("back"))
    if steps is None:
        return none
    return F.broadcast(steps).join(conf.withColumnRenamed("kind", "k"), (F.col("from") == F.col("at")) & (F.col("to") == F.col("other")) & (F.col("kind") == F.col("k"))).select("step", "from", "kind", "to", F.col("c").alias("confidence"))


def path_confidence(steps: Column) -> Column:
    """The least confidence of a way's steps; 1000 for a way without steps."""
    return F.coalesce(F.array_min(steps), F.lit(1000))


def all_paths(edges: DataFrame, source: str, target: str, max_depth: int = 4, max_paths: int = 10) -> DataFrame:
    """Simple paths as arrays of nodes, fewest hops and then smallest first; of parallel edges the most confident counts."""
    best = edges.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    paths = edges.sparkSession.createDataFrame([([source], 1000)], "nodes array<string>, confidence int")
    done = []
    for _ in range(max_depth):
        step = paths.withColumnRenamed("confidence", "c").join(best, F.element_at("nodes", -1) == F.col("source")).where(~F.array_contains("nodes", F.col("target")))
        paths = step.select(F.concat("nodes", F.array("target")).alias("nodes"), F.least("c", "confidence").alias("confidence"))
        done.append(paths.where(F.element_at("nodes", -1) == target))
        paths = paths.where(F.element_at("nodes", -1) != target)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("hops", F.size("nodes") - 1).orderBy("hops", "nodes").limit(max_paths)


def clamp_nodes(requested: int) -> int:
    return min(requested, SUBGRAPH_NODES)


def subgraph(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int = 2, max_nodes: int | None = SUBGRAPH_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes of a search bounded by depth and nodes (null: by depth alone) and all edges among them."""
    nodes, _ = bfs(edges, seeds, direction, max_depth, max_nodes if max_nodes is None else clamp_nodes(max_nodes))
    n = small(nodes.select(F.col("node_key").alias("__n")), FEW_KEYS)
    return nodes, edges.join(n, F.col("source") == F.col("__n"), "left_semi").join(n, F.col("target") == F.col("__n"), "left_semi")


def search(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 50, degrees: bool = True) -> DataFrame:
    """Nodes whose name is (0), begins with (1) or holds (2) the text, with their rank and degree, best first."""
    q, name, full = text.lower(), F.lower("name"), F.lower(F.coalesce("qualified_name", "name"))
    rank = F.when((name == q) | (full == q), 0).when(F.startswith(name, F.lit(q)) | F.startswith(full, F.lit(q)), 1).when(F.contains(name, F.lit(q)) | F.contains(full, F.lit(q)), 2)
    hit = nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "name", "node_key").limit(limit)
    return hit.join(degree(edges), "node_key", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint"))) if degrees else hit


def components(links: DataFrame) -> DataFrame:
    """node_key, component (smallest member) of undirected links a, b: stars are made larger and smaller until they stand."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("__a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "__a")
        small = large.join(least, F.col("a") == F.col("__a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("a").alias("node_key"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node_key"), F.col("b").alias("component")).distinct()).distinct()


def reachable(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """source, target of all pairs of nodes with a way between them; for graphs of modules, not of symbols."""
    pairs = cut(edges.select("source", "target").distinct())
    n, depth = pairs.count(), 1
    while max_depth is None or depth < max_depth:
        more = pairs.alias("x").join(pairs.alias("y"), F.col("x.target") == F.col("y.source")).select("x.source", "y.target")
        new = cut(pairs.unionByName(more).distinct())
        m = new.count()
        if m == n:
            break
        pairs, n, depth = new, m, depth * 2
    return pairs


def cycles(edges: DataFrame) -> DataFrame:
    """component (smallest member), members (sorted) of strongly connected components with more than one node."""
    r = reachable(edges)
    same = r.alias("x").join(r.alias("y"), (F.col("x.source") == F.col("y.target")) & (F.col("x.target") == F.col("y.source"))).select(F.col("x.source").alias("n"), F.col("x.target").alias("m")).where("n <> m")
    label = same.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("component"))
    return label.groupBy("component").agg(F.sort_array(F.collect_set("n")).alias("members"))


def widest(edges: DataFrame, seeds: DataFrame, direction: str = "in", max_depth: int = 6) -> DataFrame:
    """node_key, confidence: the best least-confidence over ways of at most max_depth steps. Each step follows only nodes that the one before found or bettered."""
    e = directed(edges, direction).select("at", "other", F.col("confidence").alias("c"))
    best = cut(seeds.select("node_key", F.lit(1000).alias("confidence")).distinct())
    front = best
    for _ in range(max_depth):
        step = front.join(at_keys(e, front), F.col("node_key") == F.col("at")).groupBy("other").agg(F.max(F.least("confidence", "c")).alias("confidence")).withColumnRenamed("other", "node_key")
        old = best.withColumnRenamed("confidence", "old")
        new = cut(old.join(step, "node_key", "full_outer").select("node_key", F.greatest("old", "confidence").alias("confidence"), (F.col("old").isNull() | (F.col("confidence") > F.col("old"))).alias("better")))
        best, front = new.select("node_key", "confidence"), new.where("better").select("node_key", "confidence")
        if not front.limit(1).count():
            break
    return best


def follow(chain: DataFrame, max_steps: int = 64) -> DataFrame:
    """from_key, to_key: each key's last successor over rows from_key (each once), to_key, after max_steps more steps at most; a cycle ends where it would close. Ways are doubled, so few joins find them."""
    now, steps = cut(chain.select("from_key", F.array("from_key", "to_key").alias("way"))), 1
    while steps < max_steps + 1:
        rest = now.select(F.col("from_key").alias("k"), F.slice("way", 2, max_steps + 1).alias("rest"))
        joined = now.join(rest, F.element_at("way", -1) == F.col("k"), "left")
        way = F.slice(F.concat("way", F.coalesce("rest", F.array().cast(rest.schema["rest"].dataType))), 1, max_steps + 2)
        now, steps = cut(joined.select("from_key", way.alias("way"), (F.col("k").isNotNull() & (F.size("way") < max_steps + 2)).alias("moved"))), steps * 2
        if not now.where("moved").limit(1).count():
            break
    # Once a key comes again, only keys of its cycle follow.
    return now.select("from_key", F.element_at(F.array_distinct("way"), -1).alias("to_key"))


def validate(nodes: DataFrame, edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """check, severity, key: duplicate nodes and edges, ends that are missing, loops, odd confidence, orphans, kinds not allowed (rules: kind, source_kind, target_kind)."""
    key = F.concat_ws("|", "source", "kind", "target")
    row = lambda df, check, sev, k: df.select(F.lit(check).alias("check"), F.lit(sev).alias("severity"), k.alias("key"))
    n = nodes.select(F.col("node_key").alias("__n")).distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("__e")).distinct()
    out = [
        row(nodes.groupBy("node_key").count().where("count > 1"), "duplicate_node", "error", F.col("node_key")),
        row(edges.groupBy("source", "kind", "target").count().where("count > 1"), "duplicate_edge", "error", key),
        row(edges.join(n, F.col("source") == F.col("__n"), "left_anti"), "missing_source", "error", key),
        row(edges.join(n, F.col("target") == F.col("__n"), "left_anti"), "missing_target", "error", key),
        row(edges.where("source = target"), "loop", "warning", key),
        row(edges.where("confidence < 0 or confidence > 1000"), "confidence", "error", key),
        row(nodes.join(ends, F.col("node_key") == F.col("__e"), "left_anti"), "orphan", "warning", F.col("node_key")),
        row(edges.where(kind_number(F.col("kind")).isNull()), "unknown_kind", "error", key),
    ]
    if rules is not None:
        k = nodes.select("node_key", F.col("kind").alias("nk"))
        typed = edges.join(k.toDF("s", "source_kind"), F.col("source") == F.col("s")).join(k.toDF("t", "target_kind"), F.col("target") == F.col("t"))
        out.append(row(typed.join(rules, ["kind", "source_kind", "target_kind"], "left_anti"), "not_allowed", "error", key))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, status (only_a, only_b, changed, same) and the names of fields that differ, nulls equal to nulls."""
    x = a.select(*keys, F.struct(*fields).alias("__x"))
    y = b.select(*keys, F.struct(*fields).alias("__y"))
    j = x.join(y, list(keys), "full_outer")
    diff = F.array_compact(F.array(*(F.when(~F.col(f"__x.{f}").eqNullSafe(F.col(f"__y.{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("__y").isNull(), "only_a").when(F.col("__x").isNull(), "only_b").when(F.size(diff) > 0, "changed").otherwise("same")
    return j.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(diff, ",")).otherwise("").alias("fields"))


