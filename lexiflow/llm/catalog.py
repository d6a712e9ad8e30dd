"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import (
    archive,
    decontaminate,
    divergence,
    hard_negatives,
    language,
    line_dedup,
    main_text,
    mixing,
    near_dedup,
    packing,
    pseudonyms,
    scoring,
    top_k,
)

SCORE_ORDER = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"), ~language.held_out(10), order=SCORE_ORDER)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pseudonyms.pseudonymise_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return replaced.select("doc_id", "n_replaced", "text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_spread_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive.archive_round_trip(_table(spark, sf_dir, "pages"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out(5)))
    held = language.held_out(5).alias("held_out")
    return language.predict(docs.select("doc_id", held, "text"), model).drop("text")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as floor(256 x); rows divisible by 50 ask for their five best others."""
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))  # null for null components, false for nan
    rows = _table(spark, sf_dir, "embeddings").filter(finite & F.forall("embedding", lambda x: ~F.isnan(x)))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vector")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    queries = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return top_k.top_k(queries, rows, 5)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as floor(256 x); labels of ids divisible by 7 are the next one's."""
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.forall("embedding", lambda x: ~F.isnan(x))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vector")
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label")
    rows = _table(spark, sf_dir, "embeddings").filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), label, vector)
    anchors = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "anchor_id")
    return hard_negatives.hard_negatives(anchors, rows)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_decontaminate": op3_decontaminate,
    "op4_scoring": op4_scoring,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_line_dedup": op6_line_dedup,
    "op7_archive": op7_archive,
    "op8_language": op8_language,
    "op9_top_k": op9_top_k,
    "op10_main_text": op10_main_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_divergence": op12_divergence,
    "op13_packing": op13_packing,
}
