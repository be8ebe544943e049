"""Vectors: hashed features, filtered nearest neighbours, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import numbers as N


def tenant(rows: DataFrame, organization: str | None, column: str) -> DataFrame:
    """Rows of one tenant; none without one."""
    return rows.where(F.lit(False) if organization is None else F.col(column) == organization)


def top_k(queries: DataFrame, points: DataFrame, k: int, key: str, vec: str, group: str | None = None, min_score: float = 0.0) -> DataFrame:
    """query, id, score, rank of the k nearest points by cosine, ties by id. Queries are few and stated; points are scanned once, and each task keeps k rows a query before they are ranked."""
    q = queries.select(F.col(key).alias("query"), N.l2_normalize(F.col(vec)).alias("__q"), *( [F.col(group).alias("__g")] if group else []))
    p = points.select(F.col(key).alias("id"), N.l2_normalize(F.col(vec)).alias("__p"), *([F.col(group).alias("__h")] if group else []))
    j = p.join(q, (F.col("__g") == F.col("__h")) if group else F.lit(True)).where("id <> query")
    j = j.select("query", "id", F.round(N.dot(F.col("__p"), F.col("__q")), 6).alias("score"))
    j = j.where(F.col("score") >= min_score) if min_score > 0 else j
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recall_at_k(truth: Column, got: Column) -> Column:
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.array_intersect(truth, got)) / F.size(truth))


def features(tokens: Column) -> Column:
    """The features of a text: its words, its neighbouring pairs and the character trigrams of its words."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit(" "), b))
    thirds = F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.concat(F.lit("t:"), F.substr(t, i, F.lit(3))))))
    return F.concat(F.transform(tokens, lambda t: F.concat(F.lit("u:"), t)), pairs, thirds)


def counted(items: Column) -> Column:
    """f, tf: the distinct items of an array without nulls and how often they occur, by the runs of the sorted array."""

    def runs(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(a, i - 1))))
        each = lambda s: F.transform(s, lambda i, j: F.struct(F.get(a, i).alias("f"), (F.coalesce(F.get(s, j + 1), F.size(a)) - i).cast("bigint").alias("tf")))
        return F.get(F.transform(F.array(starts), each), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(items)), runs), F.lit(0))


def embed(docs: DataFrame, key: str, tokens: Column, dims: int = 256) -> DataFrame:
    """key, bucket, value: sparse hashed features of unit length: signed 1 + ln tf by bucket of the md5, half of it for trigrams. A row is a whole text: its features are counted in it, and only sums by bucket are exchanged."""
    f = docs.select(F.col(key), F.explode(counted(features(tokens))).alias("x")).select(key, "x.f", "x.tf")
    h = F.conv(F.substring(F.md5("f"), 1, 8), 16, 10).cast("bigint")
    w = f.select(key, (h % dims).cast("int").alias("bucket"), (F.when(F.floor(h / dims) % 2 == 0, 1.0).otherwise(-1.0) * F.when(F.startswith("f", F.lit("t:")), 0.5).otherwise(1.0) * (1 + F.log("tf"))).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    n = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return w.withColumn("value", F.when(n > 0, F.col("v") / n).otherwise(0.0)).drop("v")
