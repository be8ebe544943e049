"""The same behaviours over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder or pattern as they come."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, window: str, *by: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_seconds("w.start").alias("bucket"), *by, "n", "total")


def not_too_old(stream: DataFrame, ts: str, now, max_age: str) -> DataFrame:
    """Events older than the age are dropped, and the watermark follows."""
    return stream.withWatermark(ts, max_age).where(F.col(ts) >= now - F.expr(f"INTERVAL {max_age}"))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there, a batch at a time, with exactly one commit a batch."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
