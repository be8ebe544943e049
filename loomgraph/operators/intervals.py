"""Lines, ranges and hunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """keys, start, end, n: half-open ranges of a key that overlap, touch or lie at most `gap` apart, as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    g = rows.withColumn("__new", new).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__g")


def innermost(lines: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Each line (key, line) with the symbol (start, end inclusive, symbol) that holds it and starts last, then ends first; null where none does."""
    s = symbols.select(F.col(key).alias("__k"), "start", "end", "symbol")
    j = lines.join(s, (F.col(key) == F.col("__k")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    return j.groupBy(key, "line").agg(F.min(F.when(F.col("symbol").isNotNull(), F.struct(-F.col("start"), F.col("end"), F.col("symbol")))).alias("b")).select(key, "line", F.col("b.symbol").alias("symbol"))


def parse_patch(patches: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of unified diffs: id, hunk, kind (context, add, del), old_no, new_no, text."""
    rows = patches.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("no", "l"))
    w = Window.partitionBy(id_col).orderBy("no")
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    rows = rows.withColumn("h", F.col("l").rlike(head)).withColumn("hunk", F.sum(F.col("h").cast("int")).over(w)).where("hunk > 0")
    for side, g in (("old", 1), ("new", 2)):
        rows = rows.withColumn(f"{side}_first", F.max(F.when(F.col("h"), F.regexp_extract("l", head, g).cast("int"))).over(Window.partitionBy(id_col, "hunk")))
    rows = rows.where("not h").withColumn("kind", F.when(F.startswith("l", F.lit("+")), "add").when(F.startswith("l", F.lit("-")), "del").when(F.startswith("l", F.lit(" ")), "context")).where("kind is not null")
    wh = Window.partitionBy(id_col, "hunk").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda skip: F.coalesce(F.sum((F.col("kind") != skip).cast("int")).over(wh), F.lit(0))
    return rows.select(id_col, "hunk", "kind", F.when(F.col("kind") != "add", F.col("old_first") + before("add")).alias("old_no"), F.when(F.col("kind") != "del", F.col("new_first") + before("del")).alias("new_no"), F.substring("l", F.lit(2), F.length("l")).alias("text"))


def nearest(points: DataFrame, lines: DataFrame, key: str, most: int) -> DataFrame:
    """Each point (key, line) with the nearest of the lines of its key within `most`, the smaller of two. Lines meet points by blocks of `most`, not all with all."""
    b = F.floor(F.col("target") / most)
    spread = lines.select(F.col(key).alias("__k"), F.col("line").alias("target")).withColumn("block", F.explode(F.array(b - 1, b, b + 1)))
    p = points.withColumn("block", F.floor(F.col("line") / most))
    j = p.join(spread, (F.col(key) == F.col("__k")) & (p.block == spread.block) & (F.abs(F.col("line") - F.col("target")) <= most), "left")
    return j.groupBy(*points.columns).agg(F.min(F.when(F.col("target").isNotNull(), F.struct(F.abs(F.col("line") - F.col("target")), F.col("target")))).alias("b")).select(*points.columns, F.col("b.target").alias("nearest"))


def cover(ranges: Column) -> Column:
    """The covered lines of an array of inclusive ranges."""
    return F.array_distinct(F.flatten(F.transform(ranges, lambda x: F.sequence(x["start"], x["end"]))))


def range_jaccard(a: Column, b: Column) -> Column:
    """Similarity of covered lines of arrays of inclusive ranges; 0 if either is empty."""
    x, y = cover(a), cover(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
