"""Decisions over jobs, budgets, collections and invalidation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reserve(requests: DataFrame, key: str, limit: int) -> DataFrame:
    """key, id, granted: requests (id, amount, order) in order, each granted if the key's limit still holds it. A key is one run's ordered array."""

    def fold(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            used, rows = 0, []
            for r in g:
                ok = used + r["amount"] <= limit
                used += r["amount"] if ok else 0
                rows.append({"id": r["id"], "granted": ok})
            out.append(rows)
        return pd.Series(out)

    run = F.pandas_udf(fold, f"array<struct<id:{requests.schema['id'].dataType.simpleString()},granted:boolean>>")
    return requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", "id", "amount"))).alias("g")).select(key, F.explode(run("g")).alias("x")).select(key, "x.id", "x.granted")


def job_states(events: DataFrame, key: str, max_attempts: int = 3) -> DataFrame:
    """key, state, attempts after claims, completions and failures (what, order), fenced by state: a claim needs a queued job, an end a running one. A key is one ordered array, folded where it is."""

    def step(now, r):
        state, attempts = now["state"], now["attempts"]
        to = lambda s, n: F.struct(s.alias("state"), n.alias("attempts"))
        ran = state == "running"
        return (
            F.when((r["what"] == "claim") & (state == "queued"), to(F.lit("running"), attempts + 1))
            .when((r["what"] == "complete") & ran, to(F.lit("done"), attempts))
            .when((r["what"] == "fail") & ran, to(F.when(attempts >= max_attempts, "dead").otherwise("queued"), attempts))
            .otherwise(to(state, attempts))
        )

    first = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("attempts"))
    g = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", "what"))).alias("g"))
    return g.select(key, F.aggregate("g", first, step).alias("x")).select(key, "x.state", "x.attempts")


def invalidation(changed: DataFrame, renamed: DataFrame, edges: DataFrame) -> DataFrame:
    """key, action: full for changed, rekey for renamed with the same body, summary for what calls, implements or extends a changed symbol; the strongest holds."""
    full = changed.select("key", F.lit(0).alias("a"))
    rekey = renamed.select("key", F.lit(1).alias("a"))
    near = edges.where(F.col("kind").isin("calls", "implements", "extends")).join(changed.select(F.col("key").alias("__k")), F.col("target") == F.col("__k"), "left_semi").select(F.col("source").alias("key"), F.lit(2).alias("a"))
    return full.unionByName(rekey).unionByName(near).groupBy("key").agg(F.get(F.array(*map(F.lit, ("full", "rekey", "summary"))), F.min("a")).alias("action"))


def collections(rows: DataFrame, now, retire_days: int = 7) -> DataFrame:
    """space, id, status: the newest ready collection (created) of a space is active, older ones retire, and go after a week."""
    lead = rows.where("ready").groupBy("space").agg(F.max_by("id", F.struct("created", "id")).alias("lead"))
    age = F.datediff(now, F.col("created")) >= retire_days
    status = F.when(F.col("id") == F.col("lead"), "active").when(~F.col("ready"), "building").when(age, "delete").otherwise("retired")
    return rows.join(lead, "space", "left").select("space", "id", status.alias("status"))


def structural_changes(facts: DataFrame) -> DataFrame:
    """symbol, class for added or removed facts (symbol, kind) of a fact diff."""
    names = {"condition": "condition_changed", "branch": "control_flow_changed", "loop": "loop_changed", "return": "return_changed"}
    return facts.where(F.col("kind").isin(*names)).select("symbol", F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("kind")).alias("class")).distinct()


def low_risk(symbols: DataFrame, overridden: DataFrame) -> DataFrame:
    """key, verdict: the first low-risk kind that holds, unless a reason overrides it or the parse is degraded."""
    kind = F.when(F.col("comment_only"), "comment_only").when(F.col("format_only"), "format_only").when(F.col("renamed_only"), "rename").when(F.col("test"), "test_only")
    s = symbols.join(overridden.select("key").distinct().withColumn("__o", F.lit(True)), "key", "left")
    return s.select("key", F.when(F.col("__o").isNotNull() | F.col("degraded"), F.lit(None).cast("string")).otherwise(kind).alias("verdict"))


def two_hops(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """node_key of what reaches a target over at most two calls."""
    call = edges.where("kind = 'calls' or kind = 'depends_on'").select("source", "target").distinct()
    one = call.join(targets.select(F.col("node_key").alias("__t")), F.col("target") == F.col("__t"), "left_semi").select(F.col("source").alias("node_key")).distinct()
    two = call.join(one.select(F.col("node_key").alias("__t")), F.col("target") == F.col("__t"), "left_semi").select(F.col("source").alias("node_key"))
    return one.unionByName(two).distinct()
