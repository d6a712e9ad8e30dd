"""Journal categories and class labels."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import journal_key
from lexiflow.operators.joins import lookup_join
from lexiflow.operators.ranks import number_rows
from lexiflow.operators.vectors import divide_by_count
from lexiflow.operators.weights import hash_percent


def _numbered(keys: DataFrame, column: str, name: str) -> DataFrame:
    """Number distinct keys from 0 in order."""
    return number_rows(keys.select(column).distinct(), name, column)


def _bare_issn(issn: Column) -> Column:
    return F.regexp_replace(issn, "^([^-]*)-", "$1")


def category_index(cats: DataFrame) -> DataFrame:
    """(category, category_id)."""
    return _numbered(cats.select("category"), "category", "category_id")


def key_to_name(cats: DataFrame) -> DataFrame:
    """(issn, journal): of several names of a journal the first in order."""
    return cats.groupBy(_bare_issn(F.col("issn")).alias("issn")).agg(
        F.min("journal").alias("journal")
    )


def multi_hot(cats: DataFrame, index: DataFrame) -> DataFrame:
    """(issn, categories, hot): category names, duplicates kept, and a 0/1 array."""
    places = lookup_join(cats, index, "category")
    grouped = places.groupBy(_bare_issn(F.col("issn")).alias("issn")).agg(
        F.sort_array(F.collect_list("category")).alias("categories"),
        F.collect_set("category_id").alias("ids"),
    )
    last = index.agg(F.max("category_id")).scalar()
    rows = grouped.withColumn("every", F.sequence(F.lit(0).cast("bigint"), last))
    hot = F.transform("every", lambda i: F.array_contains("ids", i).cast("smallint"))
    return rows.select("issn", "categories", hot.alias("hot"))


def _with_issn(df: DataFrame) -> DataFrame:
    return df.withColumn("issn", journal_key(F.col("doc_id")))


def label_unique(df: DataFrame, journals: DataFrame, index: DataFrame) -> DataFrame:
    """Add `category`: the journal's only category, else the number of categories.

    Journals with several categories and unknown ones share that catch-all class.
    """
    single = journals.where(F.size("categories") == 1).select(
        "issn", F.get("categories", F.lit(0)).alias("category")
    )
    classes = single.join(index, "category").select("issn", "category_id")
    catch_all = index.agg(F.count(F.lit(1))).scalar()
    return (
        lookup_join(_with_issn(df), classes, "issn", "left")
        .withColumn("category", F.coalesce("category_id", catch_all))
        .drop("issn", "category_id")
    )


def label_lines(labelled: DataFrame, digits: int | None = None) -> DataFrame:
    """`class,x1,x2,...` lines; optionally with a fixed number of decimals."""
    shown = "string" if digits is None else f"decimal(38,{digits})"
    coordinates = F.transform("embedding", lambda x: x.cast(shown).cast("string"))
    line = F.concat_ws(",", F.col("category").cast("string"), coordinates)
    return labelled.select(line.alias("value"))


def label_all(df: DataFrame, journals: DataFrame, index: DataFrame) -> DataFrame:
    """One row per document and category of its journal; unknown journals are dropped."""
    classes = (
        journals.select("issn", F.explode("categories").alias("category"))
        .join(index, "category")
        .select("issn", F.col("category_id").alias("category"))
    )
    return lookup_join(_with_issn(df), classes, "issn").drop("issn")


def target_index(df: DataFrame) -> DataFrame:
    """(issn, target): the journals that occur in the ids, numbered in order."""
    return _numbered(df.select(journal_key(F.col("doc_id")).alias("issn")), "issn", "target")


def labeled_points(df: DataFrame, targets: DataFrame, leading_count: bool = False) -> DataFrame:
    """(doc_id, label, features) for the classifier.

    leading_count takes the older stored form, where the sums follow their count.
    """
    joined = lookup_join(_with_issn(df), targets, "issn")
    values = divide_by_count(F.col("embedding")) if leading_count else F.col("embedding")
    return joined.select(
        "doc_id",
        F.col("target").cast("double").alias("label"),
        array_to_vector(values).alias("features"),
    )


def split_rows(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random train and test rows."""
    train, test = df.randomSplit([share, 1.0 - share], seed=seed)
    return train, test


def split_by_hash(
    df: DataFrame, share: float = 0.8, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key, without a shuffle.

    All rows of a key land on one side, so a document with several labels never
    straddles, and a rerun gives the same sides.
    """
    in_train = hash_percent(F.col(key)) < F.lit(round(share * 100))
    return df.where(in_train), df.where(~in_train)


split_groups = split_by_hash


def export_vectors(vectors: DataFrame, issns: DataFrame, digits: int | None = None) -> DataFrame:
    """`issn <tab> x1 <tab> x2 ...` lines; inner join of (doc_id, body) on the id."""
    shown = "string" if digits is None else f"decimal(38,{digits})"
    coordinates = F.transform("embedding", lambda x: x.cast(shown).cast("string"))
    joined = vectors.join(issns.select("doc_id", F.col("body").alias("issn")), "doc_id")
    return joined.select(F.concat_ws("\t", "issn", coordinates).alias("value"))
