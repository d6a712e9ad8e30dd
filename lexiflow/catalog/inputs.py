"""Inputs of the registered queries, all derived by Spark from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.operators import seeds, tokens, vectors, weights
from lexiflow.operators.ranks import number_rows
from lexiflow.session import noted, remove_all, spread, stage

# The word lexicon of the entity and annotation queries.
LEXICON = [
    ("dinitrophenol", "SYSTEMATIC", "NN", "dinitrophenol"),
    ("dichlorobenzene", "SYSTEMATIC", "NN", "dichlorobenzene"),
    ("dimethylfuran", "SYSTEMATIC", "NN", "dimethylfuran"),
    ("gave", None, "VBD", "give"),
    ("the", None, "DT", "the"),
    ("with", None, "IN", "with"),
    ("are", None, "VBP", "be"),
]
VOCABULARY_SIZE = 10_000
LSI_TERMS = 10_000
LSI_DIM = 100
FULL_LSI_TERMS = 64  # all singular values of so many terms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body, source, lang); the id holds the journal key, of every eleventh an unknown one.

    Every seventh text ends with quantities, a comparison and a chemical name.
    """
    number = F.col("doc_id")
    name = (
        F.when(number % 3 == 0, F.lit("dinitrophenol"))
        .when(number % 3 == 1, F.lit("dichlorobenzene"))
        .otherwise(F.lit("dimethylfuran"))
    )
    extra = F.lit(" (n=7) gave 12.5 % and p < 0.05 for 3 mg/l of 2,4-")
    body = F.when(number % 7 == 0, F.concat("text", extra, name, F.lit(" ."))).otherwise(
        F.col("text")
    )
    source = F.regexp_extract("source", "[0-9]+", 0).cast("bigint")
    key = _padded(F.when(number % 11 == 0, source + 5_000_000).otherwise(source))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), key, _padded(number)).alias("doc_id"),
        body.alias("body"),
        "source",
        "lang",
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus over all cores, for work on single rows."""
    return spread(corpus(spark, sf_dir))


def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus partitioned by id, for work on the tokens of a document."""
    return spread(corpus(spark, sf_dir), "doc_id")


def one_line(df: DataFrame) -> DataFrame:
    """Bodies that fit a tab-delimited line."""
    return df.withColumn("body", F.regexp_replace("body", r"[\t\r\n]+", " "))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): several rows per id."""
    return spread(
        table(spark, sf_dir, "conversations").select(
            F.col("conv_id").cast("string").alias("doc_id"), F.col("text").alias("body")
        )
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(journal, issn, category): suppliers as journals, regions as categories.

    Every fourth journal has a second category.
    """
    key = _padded(F.col("s_suppkey"))
    journals = table(spark, sf_dir, "supplier")
    placed = journals.join(
        table(spark, sf_dir, "nation"),
        F.col("s_nationkey") == F.col("n_nationkey"),
    ).select(
        "s_suppkey",
        F.col("s_name").alias("journal"),
        F.concat(F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 4)).alias("issn"),
        F.explode(
            F.when(
                F.col("s_suppkey") % 4 == 0,
                F.array("n_regionkey", ((F.col("n_regionkey") + 1) % 5)),
            ).otherwise(F.array("n_regionkey"))
        ).alias("r_regionkey"),
    )
    named = placed.join(table(spark, sf_dir, "region"), "r_regionkey")
    return named.select("journal", "issn", F.col("r_name").alias("category"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LEXICON, "term string, type string, penn_tag string, lemma string"
    )


def word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, penn_tag, lemma): the lexicon and the long words of the corpus, classed by their last letter."""
    word = F.explode(X.matches(F.col("body"), "[a-z]{5,}")).alias("term")
    words = wide(spark, sf_dir).select(word).distinct()
    last, stem = F.substring("term", -1, 1), F.expr("substr(term, 1, length(term) - 1)")
    tag = F.when(last == "s", F.lit("NNS")).when(last == "d", F.lit("VBD")).when(last == "n", F.lit("JJ"))
    lemma = F.when(last == "n", F.col("term")).otherwise(stem)
    classed = words.select("term", tag.alias("penn_tag"), lemma.alias("lemma")).where(F.col("penn_tag").isNotNull())
    given = lexicon(spark).select("term", "penn_tag", "lemma")
    return given.unionByName(classed.join(given, "term", "left_anti"))


def entity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, type): chemical names, long words and word pairs of the benchmark, a term in brackets."""
    named = lexicon(spark).where(F.col("type").isNotNull()).select("term", "type")
    texts = table(spark, sf_dir, "benchmark")

    def found(pattern: str, kind: str) -> DataFrame:
        terms = texts.select(F.explode(X.matches(F.col("text"), pattern)).alias("term"))
        return terms.distinct().select("term", F.lit(kind).alias("type"))

    marked = spark.createDataFrame([("(n=7)", "MARKED")], "term string, type string")
    parts = (found("[a-z]{9,}", "WORD"), found("[a-z]+ [a-z]+", "PAIR"), marked)
    return reduce(DataFrame.unionByName, parts, named)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term): the plain words of the benchmark texts."""
    words = F.explode(X.plain_words(F.col("text")))
    return table(spark, sf_dir, "benchmark").select(words.alias("term")).distinct()


def chemical_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.mine_seeds(wide(spark, sf_dir))


def word_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined seeds together with the words of the corpus, so dictionary words occur."""
    words = wide(spark, sf_dir).select(F.explode(X.plain_words(F.col("body"))).alias("seed"))
    return chemical_seeds(spark, sf_dir).unionByName(words.distinct())


def name_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head): the first letters of all seeds and words that the dictionary does not hold."""
    known = dictionary(spark, sf_dir)
    kept = seeds.clean_seeds(word_seeds(spark, sf_dir), known, known.where(F.lit(False)))
    return stage(seeds.seed_heads(kept), "name-heads")


def term_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, count, total) of a-z words, stored because it is read several times."""
    counts = tokens.pattern_term_counts(by_id(spark, sf_dir), stemmed=False)
    return stage(weights.with_totals(counts), "term-bag")


def term_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TF-IDF weights and document frequencies, both stored."""
    with noted() as bag_at:
        bag = term_bag(spark, sf_dir)
    freqs = stage(weights.doc_freq(bag), "doc-freq")
    weighted = stage(weights.tfidf(bag, freqs), "weights")
    remove_all(spark, bag_at)
    return weighted, freqs


def term_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies, stored; the bag they come from is not kept."""
    with noted() as bag_at:
        freqs = weights.doc_freq(term_bag(spark, sf_dir))
    freqs = stage(freqs, "doc-freq")
    remove_all(spark, bag_at)
    return freqs


def word_vectors(spark: SparkSession, sf_dir: str, freqs: DataFrame) -> DataFrame:
    """(term, vec): the given embeddings, handed to terms by rank."""
    top = number_rows(freqs, "term_id", F.desc("df"), F.asc("term"))
    given = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("term_id"), F.col("embedding").alias("vec")
    )
    return top.join(given, "term_id").select("term", "vec")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, issn, journal, abstract); titles of pages where there is one."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title")
    )
    docs = corpus(spark, sf_dir).withColumn(
        "page_id", F.substring("doc_id", 10, 8).cast("bigint")
    )
    joined = docs.join(pages, "page_id", "left")
    key = X.journal_key(F.col("doc_id"))
    return spread(joined, "doc_id").select(
        "doc_id",
        F.coalesce("page_title", F.concat(F.lit("On "), "source")).alias("title"),
        F.concat(F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 4)).alias("issn"),
        F.col("source").alias("journal"),
        F.col("body").alias("abstract"),
    )


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, path, x): one XML document per text.

    French ones bind other prefixes, those of one source are cut off and unreadable.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(sign), F.lit(entity))
    number = F.col("doc_id").cast("string")
    dc = F.when(F.col("lang") == "fr", F.lit("d")).otherwise(F.lit("dc"))
    prism = F.when(F.col("lang") == "fr", F.lit("p")).otherwise(F.lit("prism"))

    def element(prefix: Column, name: str, text: Column) -> Column:
        return F.concat(
            F.lit("<"), prefix, F.lit(f":{name}>"), text, F.lit("</"), prefix, F.lit(f":{name}>")
        )

    xocs, base = F.lit("xocs"), F.lit("base")
    x = F.concat(
        F.lit("<article xmlns:"), dc, F.lit(f'="{P.XML_NAMESPACES["dc"]}" xmlns:'),
        prism, F.lit(f'="{P.XML_NAMESPACES["prism"]}" xmlns:xocs="{P.XML_NAMESPACES["xocs"]}"'),
        F.lit(f' xmlns:base="{P.XML_NAMESPACES["base"]}"><coredata>'),
        element(base, "pii", F.concat(F.lit("S"), number, F.lit("-(x)"))),
        element(prism, "doi", F.concat(F.lit("10.1/"), number)),
        element(base, "pubmed-id", number),
        element(base, "scopus-eid", F.concat(F.lit("2-s2.0-"), number)),
        element(dc, "title", F.concat(F.lit("On "), F.col("source"))),
        element(dc, "creator", F.concat(F.lit("Writer "), F.col("lang"))),
        element(dc, "creator", F.lit("Second Writer")),
        element(prism, "issn", F.regexp_extract("source", "[0-9]+", 0)),
        element(prism, "coverDate", F.lit("2018-01-01")),
        element(xocs, "vol-iss-suppl-text", F.lit("Volume 1")),
        element(xocs, "first-page", number),
        element(xocs, "last-page", (F.col("doc_id") + 9).cast("string")),
        F.lit("<body>"),
        element(dc, "description", clean),
        F.lit("</body></coredata>"),
        F.when(F.col("source") == "src7", F.lit("")).otherwise(F.lit("</article>")),
    )
    file_name = F.concat(F.lit("S"), F.col("n_chars").cast("string"), F.lit(".xml"))
    return spread(table(spark, sf_dir, "documents")).select(
        file_name.alias("file_name"),
        F.concat_ws("/", F.lit("/tree"), "source", number, file_name).alias("path"),
        x.alias("x"),
    )


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
