"""Sentences, tokens and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.functions.stem import stem
from lexiflow.operators.joins import lookup_join
from lexiflow.session import stage

# A normaliser maps an array of tokens to an array of terms.
Normalizer = Callable[[Column], Column]

NORMALIZERS: dict[str, Normalizer] = {
    "none": lambda terms: terms,
    "lower": lambda terms: F.transform(terms, F.lower),
}


def normalize_terms(sentences: DataFrame, normalizer: str | Normalizer = "none") -> DataFrame:
    """Rewrite the terms of each sentence, by name or by a function of the array.

    `stem` and `lower_stem` go by the vocabulary; the sentences then need a doc_id.
    """
    if normalizer in ("stem", "lower_stem"):
        return stem_sentences(sentences, lower=normalizer == "lower_stem")
    chosen = NORMALIZERS[normalizer] if isinstance(normalizer, str) else normalizer
    return sentences.withColumn("terms", chosen(F.col("terms")))


def tokenize_sentences(
    df: DataFrame, normalizer: str | Normalizer = "none"
) -> DataFrame:
    """(doc_id, terms), one row per sentence; punctuation marks are tokens too."""
    rows = df.select("doc_id", F.explode(X.sentences(F.col("body"))).alias("sentence"))
    terms = rows.select("doc_id", X.tokens(F.col("sentence")).alias("terms"))
    return normalize_terms(terms.where(F.size("terms") > 0), normalizer)


def sentence_terms(df: DataFrame) -> DataFrame:
    return tokenize_sentences(df).select("terms")


def token_pairs(df: DataFrame) -> DataFrame:
    """(token, doc_id), one row per occurrence."""
    return df.select(F.explode(X.tokens(F.col("body"))).alias("token"), "doc_id")


def tokens_per_doc(df: DataFrame) -> DataFrame:
    return df.select("doc_id", X.tokens(F.col("body")).alias("tokens"))


def token_freq_per_doc(df: DataFrame, longer_than: int = 0) -> DataFrame:
    """(doc_id, token, count); optionally only tokens longer than a length."""
    return (
        token_pairs(df)
        .where(F.length("token") > longer_than)
        .groupBy("doc_id", "token")
        .count()
    )


def counts_as_map(counts: DataFrame, key: str = "term", value: str = "count") -> DataFrame:
    """The long table as one map per document, keys in order."""
    entries = F.sort_array(F.collect_list(F.struct(key, value)))
    return counts.groupBy("doc_id").agg(F.map_from_entries(entries).alias(f"{value}s"))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """(term, stem) for the distinct terms: the cost is per word type."""
    known = terms.select("term").where(F.col("term").isNotNull()).distinct()
    return known.select("term", stem(F.col("term")).alias("stem"))


def stem_sentences(sentences: DataFrame, lower: bool = False) -> DataFrame:
    """(doc_id, terms) with every term stemmed by way of the vocabulary.

    Words are numbered within their sentence, meet the stems in a join, and are put
    together again; each distinct word is stemmed once.
    """
    terms = F.transform("terms", F.lower) if lower else F.col("terms")
    rows = sentences.select("doc_id", F.monotonically_increasing_id().alias("sentence"), terms.alias("terms"))
    rows = stage(rows, "sentences").select("doc_id", "sentence", F.posexplode("terms").alias("pos", "term"))
    stems = stage(stem_vocabulary(rows), "stems")
    words = F.sort_array(F.collect_list(F.struct("pos", "stem")))["stem"]
    joined = lookup_join(rows, stems, "term")
    return joined.groupBy("sentence", "doc_id").agg(words.alias("terms")).select("doc_id", "terms")


def stem_counts(counts: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace terms by stems in a long count table and add up what falls together.

    The null term of an empty document stays.
    """
    return (
        lookup_join(counts, stems, "term", "left")
        .groupBy("doc_id", F.col("stem").alias("term"))
        .agg(F.sum("count").alias("count"))
    )


def pattern_term_counts(
    df: DataFrame,
    stop_words: DataFrame | None = None,
    min_length: int = 3,
    stemmed: bool = True,
) -> DataFrame:
    """(doc_id, term, count) of a-z words; stop words are compared with the stems.

    A document without a term stays as one row with a null term and count 0; an id may
    have several rows. Stop words are flagged in the counts, so the texts are read once. For
    stemming, the counts are stored first, so that texts are searched only once, and
    each distinct word is stemmed once.
    """
    words = F.explode_outer(X.letter_terms(F.col("body"), min_length))
    counts = (
        df.select("doc_id", words.alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("term").alias("count"))
    )
    if stemmed:
        counts = stage(counts, "word-counts")
        stems = stage(stem_vocabulary(counts), "stems")
        counts = stem_counts(counts, stems)
    if stop_words is not None:
        stops = stop_words.select("term").distinct().withColumn("is_stop", F.lit(True))
        flagged = lookup_join(counts, stops, "term", "left")
        counts = flagged.select(
            "doc_id", F.when(F.col("is_stop").isNull(), F.col("term")).alias("term"), "count"
        )
    return _without_empty(counts)


def _without_empty(counts: DataFrame) -> DataFrame:
    """Null terms out, but for one row with count 0 of a document that has no other."""
    of_doc = Window.partitionBy("doc_id")
    marked = counts.withColumn("terms", F.count("term").over(of_doc)).withColumn(
        "place", F.row_number().over(of_doc.orderBy("term"))
    )
    kept = F.col("term").isNotNull() | ((F.col("terms") == 0) & (F.col("place") == 1))
    count = F.when(F.col("term").isNull(), F.lit(0)).otherwise(F.col("count")).cast("bigint")
    return marked.where(kept).select("doc_id", "term", count.alias("count"))


def ptb_tokens(df: DataFrame) -> DataFrame:
    """(doc_id, token): Treebank-style tokens of each line."""
    lines = df.select("doc_id", F.explode(F.split("body", "\n")).alias("line"))
    return lines.select("doc_id", F.explode(X.treebank_tokens(F.col("line"))).alias("token"))


def token_shapes(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("shape", X.token_shape(F.col("token")))


def oov_counts(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words missing from the dictionary with their counts, in word order.

    Words are counted first, so the join sees each word once and has no hot key.
    """
    counts = (
        df.select(F.explode(X.plain_words(F.col("body"))).alias("term")).groupBy("term").count()
    )
    known = dictionary.select("term").distinct()
    return counts.join(known, "term", "left_anti").orderBy("term")
