"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its share of all words by weight, at most `max_copies` times its own size, what is
above shared again by weight until none is above. That is the level L with sum(min(cap, L * weight)) = all words, found
from the order of cap / weight. A source's copies are target / source size: the whole part is taken for certain, the rest p
is its documents' chance of one more copy, which is not the same for all: a document of size s in a source of mean size m
has the inclusion probability l = min(2 p m / (m + s), (1 + p) / 2), as a repeated long document brings more of the same than
several short ones. Documents are ranked by Pareto's value, the random odds u / (1 - u) over the inclusion odds l / (1 - l),
and taken in that order until the source's words are reached, which makes the sample's size fixed; the document at the border
gives only its first words that still fit, so every source meets its rounded target.

u comes from the md5 of the id, so reruns agree. Ranks are not made by sorting a source in one task: the values fall
into `BINS` equal bins of q / (1 + q), words are summed by source and bin, and only rows of the one bin at the border
are put in order.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source, last in order; a source
without words has target 0; rows with equal ids and sizes have equal ranks, in which any order gives the same takes to the
row; other rows with equal values go by size, the larger first; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BINS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, mean_size, target; sizes has source and size. One row a source, ordered windows over those rows only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank)).withColumn("cap", F.lit(max_copies) * F.col("source_size"))
    whole = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("capped", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("source_size").over(whole))
    # The level if this source and all after it stay under their caps. It rises while sources are below it and falls after.
    per = per.withColumn("level", (F.col("all") - F.coalesce("capped", F.lit(0))) / F.col("open"))
    per = per.withColumn("water", F.max("level").over(whole))
    return per.select("source", "source_size", "mean_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def random_unit(key: Column, seed: str = "") -> Column:
    """Uniform in (0, 1) from the md5 of the key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (whole copies taken for certain)."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    goal = targets(sized, weights, max_copies)
    u = random_unit(F.col("doc_id"), seed)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    d = d.withColumn("copies", F.least(F.floor(want), F.lit(max_copies)).cast("long")).withColumn("p", want - F.col("copies")).withColumn("u", u)
    chance = F.least(2 * F.col("p") * F.col("mean_size") / (F.col("mean_size") + F.col("size")), (1 + F.col("p")) / 2)
    d = d.withColumn("chance", F.when(F.col("p") > 0, chance))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    d = d.withColumn("q", F.when(F.col("p") > 0, q)).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    d = d.withColumn("left", (F.round("target") - F.col("copies") * F.col("source_size")).cast("long"))
    sums = d.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
    border = sums.where("before < left and before + words >= left").groupBy("source").agg(F.min(F.struct("bin", "before")).alias("at"))
    d = d.join(border.withColumnRenamed("source", "border_source"), F.col("source").eqNullSafe(F.col("border_source")), "left").drop("border_source")
    edge = (F.col("q").isNotNull()) & (F.col("bin") == F.col("at.bin"))
    inside = d.where(edge)
    order = Window.partitionBy("source").orderBy("q", F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("at.before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    rest = d.where(~F.coalesce(edge, F.lit(False))).withColumn("extra", F.when(F.col("q").isNotNull() & (F.col("left") > 0) & (F.col("at").isNull() | (F.col("bin") < F.col("at.bin"))), F.col("size")).otherwise(0))
    return inside.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "copies")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents, null texts with size 0."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same level and Pareto's order, with one running sum over a whole source.
MIX_SQL = r"""
{pre} d as (select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from {docs}),
s as (select source, sum(size) as source_size, avg(size) as mean_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by 1),
o as (select *, 3 * source_size as cap, coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
  sum(w) over (order by 3 * source_size / w, source nulls last rows between current row and unbounded following) as open, sum(source_size) over () as total from s),
l as (select *, (total - capped)::double / open as level from o),
g as (select source, source_size, mean_size, least(cap::double, coalesce(max(level) over (), 0) * w) as target from l),
e as (select d.*, source_size, mean_size, target, case when source_size > 0 then target / source_size else 0 end as want, ((('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0 as u
  from d join g on d.source is not distinct from g.source),
f as (select *, least(floor(want), 3)::bigint as copies from e),
r as (select *, want - copies as p, round(target)::bigint - copies * source_size as room from f),
c as (select *, case when p > 0 then least(2 * p * mean_size / (mean_size + size), (1 + p) / 2) end as chance from r),
q as (select *, (u / (1 - u)) / (chance / (1 - chance)) as q from c),
t as (select *, coalesce(sum(size) over (partition by source order by q, size desc, doc_id rows between unbounded preceding and 1 preceding), 0) as before from q)
"""
_TAKEN = "(copies * size + case when p > 0 then greatest(0, least(size, room - before)) else 0 end)::bigint"
OP6_SQL = MIX_SQL.format(pre="with", docs="documents") + f"select doc_id, size::bigint as size, source_size::bigint as source_size, target, {_TAKEN} as taken from t"
