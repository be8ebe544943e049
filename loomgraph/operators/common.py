"""Shared by operators: where to cut lineage, what may be sent to all executors, ranks over a whole table."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one of spark.checkpoint.dir, else a temporary one where all run on one machine; a cluster without one is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, without lineage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df marked for broadcast if its rows were counted and are few enough, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with the rank (from 1) of each row in an order of the whole table, dealt by ranges, so that no task sorts all rows."""
    parts = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").count().toDF("__of", "__size")  # one row a partition
    starts = sizes.select("__of", F.coalesce(F.sum("__size").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(starts), F.col("__part") == F.col("__of")).withColumn(name, (own + F.col("__start")).cast("int")).drop("__part", "__of", "__start")
