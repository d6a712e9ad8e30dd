"""Bags of words, document frequencies and TF-IDF over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.joins import lookup_join
from lexiflow.session import stage

# Totals of documents within these bounds go to the bag.
TOTAL_ROWS = 4_000_000
TOTAL_BYTES = 256 * 1024 * 1024


def bow_per_doc(sentences: DataFrame) -> DataFrame:
    """(doc_id, term, count) over any number of sentence rows per document.

    Grouping by both columns with map-side sums spreads even a document that holds
    a large share of all sentences.
    """
    terms = sentences.select("doc_id", F.explode("terms").alias("term"))
    return terms.groupBy("doc_id", "term").count()


def doc_freq(bow: DataFrame) -> DataFrame:
    """(term, df): documents per term."""
    known = bow.where(F.col("term").isNotNull())
    return known.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_count(bow: DataFrame) -> DataFrame:
    """One row (num_docs): documents of the bag, empty ones included where kept."""
    return bow.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("num_docs"))


def with_totals(bow: DataFrame) -> DataFrame:
    """The bag and `total`, the counts of the document added up: nothing is exchanged in a bag laid by document."""
    return bow.withColumn("total", F.sum("count").over(Window.partitionBy("doc_id")))


def tfidf(bow: DataFrame, df: DataFrame | None = None, num_docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight) with weight = count / total in document * ln(N / df).

    No smoothing: a term of every document weighs 0. The bag is used several times,
    so pass one that is stored. df and num_docs default to those of the bag. Terms without
    a row in df are left out, but count in the totals of their documents. A bag with a column
    `total` is weighted where it lies, but for a large df; the totals of another are stored and
    go to it, or meet it in a join beyond the bounds.
    """
    df = doc_freq(bow) if df is None else df
    num_docs = doc_count(bow) if num_docs is None else num_docs
    n = num_docs.select(F.col("num_docs").cast("double")).scalar()
    known = bow.where(F.col("term").isNotNull())
    if "total" not in bow.columns:
        totals = stage(known.groupBy("doc_id").agg(F.sum("count").alias("total")), "totals")
        known = lookup_join(known, totals, "doc_id", max_rows=TOTAL_ROWS, max_bytes=TOTAL_BYTES)
    known = known.where(F.col("doc_id").isNotNull())
    rated = lookup_join(known, df.select("term", F.log(n / F.col("df")).alias("idf")), "term")
    share = F.col("count") / F.col("total")
    return rated.select("doc_id", "term", (share * F.col("idf")).alias("weight"))


def weights_by_term(weights: DataFrame) -> DataFrame:
    """(term, doc_id, weight); a `weights` map column is exploded, a long table reordered."""
    if "weights" in weights.columns:
        weights = weights.select("doc_id", F.explode("weights").alias("term", "weight"))
    return weights.select("term", "doc_id", "weight")


def hash_percent(key: Column) -> Column:
    """0..99 from the key's MD5: the same row lands on the same side in every run."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")) % 100


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample."""
    return df.sample(fraction=fraction, seed=seed)


def sample_by_hash(df: DataFrame, fraction: float, key: str = "doc_id") -> DataFrame:
    """Sample chosen by the key itself, so it is repeatable across layouts."""
    return df.where(hash_percent(F.col(key)) < F.lit(round(fraction * 100)))
