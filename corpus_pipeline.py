"""A training corpus from documents: five stages, each an operator of loomgraph.llm, each on all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs as they came.

Defined cases: null, empty and letterless texts go at the first stage; where docs has no lang or no rows the first stage
keeps nothing, and the later ones return no rows; rows with equal ids stay together. Of the last stage's columns (size,
source_size, target, taken) those that documents has too give way to the stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, linededup, mixing, neardup
from loomgraph.llm.common import free, word_count
from loomgraph.operators.common import shared_folder

Stage = DataFrame


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is one of gone."""
    key = free("id", docs)
    return docs.join(gone.select(F.col("doc_id").alias(key)).distinct(), docs.doc_id.eqNullSafe(F.col(key)), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Documents whose language is rejected go: those without a letter, and those beyond their language's calibrated limit."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return without(docs, langid.identify(docs.select("doc_id", "text"), model).where("rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Lines like an earlier line go; a document of which no word is left stays, with what is left."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Of each group of near-duplicates over five-word shingles the document with the smallest id stays."""
    return without(docs, neardup.link(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Documents that hold a window of any benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contamination(docs, benchmark).where(F.size("spans") > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Stage:
    """Documents of which the mix takes words, with how many; the sources come to their target weights."""
    own = ("size", "source_size", "target", "taken")
    docs = docs.drop(*own)
    # Rows of one id and size are told apart by a number, so that each gets one take.
    key, size, nr = free("id", docs), free("words", docs), free("nr", docs)
    take = mixing.mix(docs).select(F.col("doc_id").alias(key), F.col("size").alias(size), F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.desc("taken"))).alias(nr), *own).where("taken > 0")
    docs = docs.withColumn(size, word_count(F.col("text")))
    docs = docs.withColumn(nr, F.row_number().over(Window.partitionBy("doc_id", size).orderBy("text")))
    mine, its = docs.alias("mine"), take.alias("its")
    both = mine.join(its, F.col("mine.doc_id").eqNullSafe(F.col(f"its.{key}")) & (F.col(f"mine.{size}") == F.col(f"its.{size}")) & (F.col(f"mine.{nr}") == F.col(f"its.{nr}")))
    return both.select(*(F.col(f"mine.{c}") for c in docs.columns if c not in (size, nr)), *(F.col(f"its.{c}") for c in own))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, what lies between them written to the shared checkpoint folder; what a later stage has replaced there is removed."""
    shared = shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                old = spark._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            before = path
    return docs


#: Language models are no SQL; a test holds the stages to plain Python, each on its own input.
ORACLE_SQL = None
