"""Texts cut into sections and windows of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, no (from 0), line."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))


def sections(docs: DataFrame, id_col: str, text_col: str, is_heading: Callable[[Column], Column]) -> DataFrame:
    """Lines counted under the heading that they follow (null before the first): id, section, n_lines, first_line."""
    rows = numbered_lines(docs, id_col, text_col)
    head = F.last(F.when(is_heading(F.col("line")), F.col("line")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("no"))
    return rows.withColumn("section", head).groupBy(id_col, "section").agg(F.count("*").alias("n_lines"), F.min("no").alias("first_line"))


def line_windows(lines: Column, size: int = 60, step: int = 50) -> Column:
    """Half-open windows over n lines, the last one ending at n."""
    n = lines.cast("int")
    last = F.greatest(n - size, F.lit(0))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s < last + step))
    starts = F.array_distinct(F.concat(starts, F.when(F.element_at(starts, -1) + size < n, F.array(F.element_at(starts, -1) + step)).otherwise(F.array().cast("array<int>"))))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
