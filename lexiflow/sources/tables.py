"""Corpus, table and word-list readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.session import spread

ARTICLE_FIELDS = ("pii", "title", "c2", "issn", "journal", "c5", "abstract", "c7")
ARTICLE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ARTICLE_FIELDS])
CATEGORY_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("journal", "issn", "category", "dummy")]
)

# Schemas of saved stages.
CORPUS = "doc_id string, body string"
TAG = "struct<start:int,end:int,text:string,type:string>"
TAGGED_CORPUS = f"doc_id string, body string, tags array<{TAG}>"
SENTENCES = "doc_id string, terms array<string>"
BAG = "doc_id string, term string, count bigint"
WEIGHTS = "doc_id string, term string, weight double"
TOKEN_PAIRS = "token string, doc_id string"
WORD_VECTORS = "term string, vec array<float>"
DOC_VECTORS = "doc_id string, embedding array<double>"
JOURNAL_CATEGORIES = "issn string, categories array<string>, hot array<smallint>"


def scan_id_text(
    spark: SparkSession,
    path: str,
    heading: str = P.GLUED_HEADING,
    partition_by_id: bool = False,
) -> DataFrame:
    """`<id>.xml <tab> body` lines -> (doc_id, body).

    Lines with another number of fields or another kind of id are dropped. Trailing
    empty fields do not count, so a line without a body is dropped too. The corpus is moved only
    if partition_by_id is asked for, by a caller who works on the tokens of documents next.
    """
    fields = F.split(F.regexp_replace("value", r"\t+\z", ""), "\t")
    rows = (
        spark.read.text(path)
        .select(fields.alias("f"))
        .where((F.size("f") == 2) & F.col("f")[0].rlike(P.FILE_ID))
        .select(
            X.strip_suffix(F.col("f")[0]).alias("doc_id"),
            X.unglue_heading(F.col("f")[1], heading).alias("body"),
        )
    )
    return spread(rows, "doc_id") if partition_by_id else rows


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """The tab-delimited article table; quotes are ordinary characters."""
    return spark.read.csv(
        path, sep="\t", header=True, schema=ARTICLE_SCHEMA, quote="", escape=""
    )


def scan_tsv_field(spark: SparkSession, path: str, field: str = "abstract") -> DataFrame:
    """(doc_id, body) for one of title, issn, journal, abstract."""
    return scan_articles(spark, path).select(
        F.col("pii").alias("doc_id"), F.col(field).alias("body")
    )


def scan_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, sep="\t", header=True, schema=CATEGORY_SCHEMA, quote="", escape=""
    ).select("journal", "issn", "category")


def scan_terms(spark: SparkSession, path: str, name: str = "term") -> DataFrame:
    """Word lists, one or several words per line -> distinct words."""
    return words_of(spark.read.text(path), "value", name)


def scan_lines(spark: SparkSession, path: str, name: str = "term") -> DataFrame:
    """Term lists whose terms may hold spaces: one per line, kept as written."""
    return spark.read.text(path).select(F.col("value").alias(name)).distinct()


def words_of(df: DataFrame, column: str, name: str = "term") -> DataFrame:
    word = F.explode(F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " "))
    return df.select(word.alias(name)).where(F.col(name) != "").distinct()


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reload a saved stage under its typed schema."""
    return spark.read.schema(schema).parquet(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, SENTENCES).select("terms")


def load_token_pairs(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, TOKEN_PAIRS)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, WORD_VECTORS)


def load_categories(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, JOURNAL_CATEGORIES)
