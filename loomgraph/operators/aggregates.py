"""Aggregations with a rule to them: merges, ratios, intervals, percentiles, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """rows with `collides`: whether another row has the same key."""
    return rows.withColumn("collides", F.count("*").over(Window.partitionBy(key)) > 1)


def percentile(value: str, p: float) -> Column:
    """Nearest-rank percentile as an aggregate: the value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")
