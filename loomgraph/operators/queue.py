"""Queues, rate limits, state machines and time series, in batch form."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Idempotent enqueue: the first row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*order, F.struct(*rest).alias("__r"))).alias("b")).select(key, *(F.col(f"b.__r.{c}").alias(c) for c in rest))


def replays(rows: DataFrame, key: str, body: str, *order: str) -> DataFrame:
    """rows with verdict: first, duplicate (same body as the first), replay (another body under the key)."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(body).over(w)
    return rows.withColumn("verdict", F.when(F.row_number().over(w) == 1, "first").when(F.col(body).eqNullSafe(first), "duplicate").otherwise("replay"))


def rate_limited(rows: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """rows with limited: whether over `limit` in their fixed window; order by time, then event id column `event_id`."""
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    return rows.withColumn("limited", F.row_number().over(Window.partitionBy(key, slot).orderBy(ts, "event_id")) > limit)


def token_bucket(rows: DataFrame, key: str, ts_ms: str, cost: str, capacity: float, per_ms: float) -> DataFrame:
    """key, event_id, allowed, level after: a bucket of tokens per key, full at first. A key is folded in order of time."""

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        level, last, out = capacity, None, []
        for r in df.sort_values([ts_ms, "event_id"]).itertuples():
            t, c = getattr(r, ts_ms), getattr(r, cost)
            level = min(capacity, level + (0 if last is None else (t - last) * per_ms))
            last = t
            ok = level >= c
            level -= c if ok else 0
            out.append((getattr(r, key), r.event_id, ok, level))
        return pd.DataFrame(out, columns=[key, "event_id", "allowed", "level"])

    return rows.groupBy(key).applyInPandas(fold, f"{key} {rows.schema[key].dataType.simpleString()}, event_id long, allowed boolean, level double")


def lease_state(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """State after a sweep: running jobs whose lease is over go back to queued, or to dead at the last attempt."""
    over = (F.col("state") == "running") & (F.col("locked_until") < now)
    return jobs.withColumn("next_state", F.when(over & (F.col("attempts") >= max_attempts), "dead").when(over, "queued").otherwise(F.col("state")))


def claim(jobs: DataFrame, queue: str, *order: Column) -> DataFrame:
    """The job of each queue that is claimed next."""
    return jobs.withColumn("rn", F.row_number().over(Window.partitionBy(queue).orderBy(*order))).where("rn = 1").drop("rn")


def buckets(rows: DataFrame, ts: str, seconds: int, *by: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds


def bucket_sum(rows: DataFrame, ts: str, seconds: int, value: str, by: Sequence[str] = ()) -> DataFrame:
    """bucket (epoch seconds), by, total, n."""
    return rows.groupBy(buckets(rows, ts, seconds).alias("bucket"), *by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def bucket_percentile(rows: DataFrame, ts: str, seconds: int, value: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """bucket, by, value at nearest rank p."""
    return rows.groupBy(buckets(rows, ts, seconds).alias("bucket"), *by).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias("p"))


def held_breaches(series: DataFrame, key: str, bucket: str, value: str, limit: float, hold: int, step: int) -> DataFrame:
    """key, start, end, n: runs of consecutive buckets over the limit that last at least `hold` buckets."""
    hit = series.where(F.col(value) > limit)
    g = F.col(bucket) - F.row_number().over(Window.partitionBy(key).orderBy(bucket)) * step
    return hit.withColumn("__g", g).groupBy(key, "__g").agg(F.min(bucket).alias("start"), F.max(bucket).alias("end"), F.count("*").alias("n")).where(F.col("n") >= hold).drop("__g")


def counter_increase(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """rows with increase since the row before; a fall is a reset and counts from zero."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("increase", F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def ratio_alert(rows: DataFrame, ts: str, seconds: int, bad: Column, limit: float, least: int, by: Sequence[str] = ()) -> DataFrame:
    """bucket, by, ratio, n where the share of bad rows passes a limit with at least `least` rows."""
    return rows.groupBy(buckets(rows, ts, seconds).alias("bucket"), *by).agg((F.count_if(bad) / F.count("*")).alias("ratio"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("ratio") > limit))


def hash_chain(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, order, prev, hash: each row's digest over the one before and its payload; a tenant's log is one sequence."""

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        prev, out = "", []
        for r in df.sort_values(order).itertuples():
            h = hashlib.sha256(f"{prev}|{getattr(r, payload)}".encode()).hexdigest()
            out.append((getattr(r, key), getattr(r, order), prev, h))
            prev = h
        return pd.DataFrame(out, columns=[key, order, "prev", "hash"])

    k, o = (rows.schema[c].dataType.simpleString() for c in (key, order))
    return rows.groupBy(key).applyInPandas(fold, f"{key} {k}, {order} {o}, prev string, hash string")


def chain_breaks(log: DataFrame, rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, first_bad: where a log's digests stop to fit; null for whole logs. Each row is checked by its neighbour alone."""
    w = Window.partitionBy(key).orderBy(order)
    j = log.join(rows.select(key, order, payload), [key, order])
    bad = (F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit(""))) | (F.col("hash") != F.sha2(F.concat_ws("|", "prev", F.col(payload).cast("string")), 256))
    return j.withColumn("bad", bad).groupBy(key).agg(F.min(F.when(F.col("bad"), F.col(order))).alias("first_bad"))
