"""Sinks: snapshots as partitions, content-addressed appends, stage outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, root: str, snapshot_id: str) -> str:
    """A snapshot's folder, all or nothing; one that is there is an error."""
    path = f"{root}/snapshot_id={snapshot_id}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def write_delta(added: DataFrame, removed: DataFrame, root: str, snapshot_id: str) -> str:
    """Additions and tombstones of a delta as one folder with a flag."""
    both = added.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)), allowMissingColumns=True)
    return write_snapshot(both, root, snapshot_id)


def new_rows(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored, each key once: what a content-addressed append writes."""
    return rows.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def conflicts(rows: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys stored with another value than now."""
    return rows.join(stored.select(*keys, F.col(value).alias("__stored")), list(keys)).where(F.col(value) != F.col("__stored")).select(*keys, F.col("__stored").alias("stored"), F.col(value).alias("given"))


def compact(parts: Sequence[tuple[DataFrame, DataFrame]], base: DataFrame, keys: Sequence[str], root: str, snapshot_id: str) -> str:
    """A chain flattened and written as a new full snapshot; the old ones stay."""
    from loomgraph.operators.versioning import flatten

    return write_snapshot(flatten(base, parts, keys), root, snapshot_id)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot_id={snapshot_id}")
