"""A training corpus from raw documents, in five stages, each written and read again."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.columns import unused
from lexiflow.llm.decontaminate import decontaminate
from lexiflow.llm.language import keep_known_languages
from lexiflow.llm.line_dedup import drop_spread_lines
from lexiflow.llm.mixing import mix, word_count
from lexiflow.llm.near_dedup import drop_near_duplicates
from lexiflow.session import stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language: null and empty texts, texts without letters.

    Rows are judged one by one, so repeated rows stay or go together; an empty table stays empty.
    """
    return keep_known_languages(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines; a document that loses all its text goes.

    Null and empty texts stay as they are; rows equal in doc_id and text lose the same lines.
    """
    return drop_spread_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as the mix takes it, numbered from 1 by a last column, `copy`.

    A column `copy` of the documents keeps its name; the number is then `copy_`. Rows of one
    doc_id, source and text size share their copies evenly; the first get those left over.
    """
    same = ["id", "site", "words"]
    taken = mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("site"), F.col("size").alias("words"))
    taken = taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    keyed = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("site"), word_count(F.col("text")).alias("words")
    )
    alike = reduce(and_, [keyed[c].eqNullSafe(taken[c]) for c in same])
    met = keyed.join(taken, alike).select("doc", *[keyed[c] for c in same], "copies", "n")
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("doc.text")))
    alone = met.filter("n = 1").select("doc", "copies")
    shared = met.filter("n > 1").withColumn("place", place).select("doc", F.expr("copies div n + int(place <= copies % n)").alias("copies"))
    numbers = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(unused("copy", docs))
    return alone.union(shared).filter("copies > 0").select("doc.*", numbers)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_dedup_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

# A trained model and near-duplicate components are beyond SQL; tests/llm compare each stage
# with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
