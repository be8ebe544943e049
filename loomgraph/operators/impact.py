"""What a change reaches: callers, types, tests, resources, clusters, plans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.common import cut
from loomgraph.operators.graph import at_keys, components, directed


def expand(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, cap: int, floor: int = 0) -> DataFrame:
    """seed, node, distance, confidence, path: the best trail of each seed to each node, by least confidence, then distance, then nodes.

    Weak trails (under the floor) are listed but not followed; each level keeps `cap` nodes a seed by the confidence of their edge, then key.
    """
    around = directed(edges, direction)
    level = seeds.select(F.col("node_key").alias("seed"), F.col("node_key").alias("node"), F.lit(0).alias("distance"), F.lit(1000).alias("confidence"), F.array("node_key").alias("path"))
    done = None
    for k in range(1, depth + 1):
        e = at_keys(around, level.select(F.col("node").alias("node_key"))).groupBy("at", "other").agg(F.max("confidence").alias("c"))
        step = level.where(F.col("confidence") >= floor).join(e, F.col("node") == F.col("at")).where(~F.array_contains("path", F.col("other")))
        step = step.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("c"), "other"))).where(F.col("rn") <= cap)
        level = step.select("seed", F.col("other").alias("node"), F.lit(k).alias("distance"), F.least("confidence", "c").alias("confidence"), F.concat("path", F.array("other")).alias("path"))
        done = level if done is None else done.unionByName(level)
    return best_trails(done)


def best_trails(trails: DataFrame) -> DataFrame:
    """The best trail a seed and node, and in `others` how many more there are."""
    w = Window.partitionBy("seed", "node")
    order = w.orderBy(F.desc("confidence"), "distance", "path")
    return trails.withColumn("rn", F.row_number().over(order)).withColumn("others", F.count("*").over(w) - 1).where("rn = 1").drop("rn")


def removed_callees(base: DataFrame, head: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node that a seed called in base and no longer calls in head."""
    call = lambda e: e.where("kind = 'calls'").join(seeds.select(F.col("node_key").alias("__k")), F.col("source") == F.col("__k"), "left_semi").select(F.col("source").alias("seed"), F.col("target").alias("node")).distinct()
    return call(base).join(call(head), ["seed", "node"], "left_anti")


def siblings(implements: DataFrame, members: DataFrame, most: int = 4096) -> DataFrame:
    """member, sibling: members of equal name of two classes (owner) that implement one contract.

    All pairs of a contract and name are asked for: they are made in parts of `most` members against all, each part a task's.
    A pair that several contracts make is kept at the least of them, so pairs are never exchanged.
    """
    m = members.join(implements, "owner").where("contract is not null and name is not null and key is not null").select("key", F.struct("contract", "name").alias("g"))
    m = cut(m.groupBy("key").agg(F.sort_array(F.collect_set("g")).alias("gs")).select("key", "gs", F.explode("gs").alias("g")))
    parts = -(-(m.groupBy("g").count().agg(F.max("count")).head()[0] or 1) // most)
    n = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    x = m.select(F.col("key").alias("member"), F.col("gs").alias("xs"), "g", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")).repartition(n, "g", "part")
    y = m.select(F.col("key").alias("sibling"), F.col("gs").alias("ys"), "g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(n, "g", "part")
    first = (F.size("xs") == 1) | (F.size("ys") == 1) | (F.col("g") == F.array_min(F.array_intersect("xs", "ys")))
    return x.join(y, ["g", "part"]).where((F.col("member") != F.col("sibling")) & first).select("member", "sibling")


def test_scores(signals: DataFrame, include: float = 0.6, covered: float = 0.8) -> DataFrame:
    """test, symbol, score, included, covered: noisy-OR over the most of each kind of signal."""
    per = signals.groupBy("test", "symbol", "kind").agg(F.max("weight").alias("w")).groupBy("test", "symbol").agg(F.round(1 - F.product(1 - F.col("w")), 4).alias("score"))
    return per.withColumn("included", F.col("score") >= include).withColumn("covered", F.col("score") >= covered)


def clusters(links: DataFrame, members: DataFrame) -> DataFrame:
    """member, cluster: components of links a, b; members without a link are their own."""
    c = components(links.select("a", "b"))
    return members.join(c, F.col("member") == F.col("node_key"), "left").select("member", F.coalesce("component", "member").alias("cluster"))


def split_oversized(links: DataFrame, cluster_of: DataFrame, most: int = 12) -> DataFrame:
    """member, part (least member): clusters of over `most` members lose their weakest links (weight, ends), one after the other, until all parts fit. A cluster is a pull request's, so one task holds it."""

    def strongest(df: pd.DataFrame) -> pd.DataFrame:
        # What is left after the weakest links go is a run of the strongest: they are joined until a part would not fit.
        nodes = sorted(set(df.a) | set(df.b))
        parent, size = {n: n for n in nodes}, dict.fromkeys(nodes, 1)

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for _, a, b in sorted(df[["weight", "a", "b"]].itertuples(index=False, name=None), reverse=True):
            x, y = sorted((find(a), find(b)))
            if x != y:
                if size[x] + size[y] > most:
                    break
                parent[y], size[x] = x, size[x] + size[y]
        return pd.DataFrame({"member": nodes, "part": [find(n) for n in nodes]})

    kind = links.schema["a"].dataType.simpleString()
    j = links.join(cluster_of, F.col("a") == F.col("member")).select("cluster", "a", "b", "weight")
    return j.groupBy("cluster").applyInPandas(strongest, f"member {kind}, part {kind}")


def plan_rank(clusters: DataFrame) -> DataFrame:
    """cluster, rank score: min(1, base + 0.1 min(high / 3, 1) + 0.05 reachable), position by score, size, id."""
    score = F.least(F.lit(1.0), F.col("base") + 0.1 * F.least(F.col("high") / 3, F.lit(1.0)) + 0.05 * F.col("reachable").cast("int"))
    return clusters.withColumn("score", F.round(score, 6)).withColumn("position", F.row_number().over(Window.partitionBy("pr").orderBy(F.desc("score"), F.desc("size"), "cluster")))


def spend(plan: DataFrame, budget: int) -> DataFrame:
    """plan with `planned`: high and critical always, then medium and low in order of position while they fit (low only with 30 % left). A pull request's clusters are one ordered array."""

    def fold(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            left, took = budget, {}
            for want in (("critical", "high"), ("medium",), ("low",)):
                for r in g:
                    if r["level"] in want:
                        ok = want[0] == "critical" or (r["cost"] <= left and (want[0] != "low" or left >= 0.3 * budget))
                        left -= r["cost"] if ok else 0
                        took[r["cluster"]] = ok
            out.append([{"cluster": c, "planned": p} for c, p in took.items()])
        return pd.Series(out)

    kind = plan.schema["cluster"].dataType.simpleString()
    run = F.pandas_udf(fold, f"array<struct<cluster:{kind},planned:boolean>>")
    return plan.groupBy("pr").agg(F.sort_array(F.collect_list(F.struct("position", "cluster", "level", "cost"))).alias("g")).select("pr", F.explode(run("g")).alias("x")).select("pr", "x.cluster", "x.planned")


def first_route(candidates: DataFrame, keys: Sequence[str], allowed: Column) -> DataFrame:
    """The first permitted entry of each key by order."""
    return candidates.where(allowed).groupBy(*keys).agg(F.min_by("entry", "order").alias("entry"))
