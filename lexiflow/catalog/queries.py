"""The registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.catalog import inputs as I
from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.operators import (
    annotate,
    classify,
    entities,
    labels,
    lsi,
    rewrite,
    search,
    seeds,
    tokens,
    vectors,
    weights,
    word_vectors,
)
from lexiflow.plans import classify_journals, text_mining
from lexiflow.session import fresh_path, spread, stage
from lexiflow.settings import MiningSettings
from lexiflow.sources import sinks, tables, xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _words(column: str) -> Column:
    return F.array_join(column, " ").alias(column)


def _rounded(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)


def _coordinates(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per coordinate."""
    return df.select(*keep, F.posexplode(column).alias("pos", "value")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), _rounded("value")
    )


# --- sources and sinks ----------------------------------------------------------------


def _id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.one_line(I.wide(spark, sf_dir))
    bad_id = F.concat(F.lit("X"), "doc_id", F.lit(".xml\t"), "body")
    three = F.concat("doc_id", F.lit(".xml\t"), "body", F.lit("\tmore"))
    good = F.concat("doc_id", F.lit(".xml\tAbstract"), "body")
    lines = F.array(
        good,
        F.when(F.col("lang") == "fr", bad_id),
        F.when(F.col("lang") == "de", three),
    )
    return docs.select(F.explode(F.array_compact(lines)).alias("value"))


@query
def scan_id_text(spark, sf_dir):
    path = fresh_path(spark, "id-text")
    _id_lines(spark, sf_dir).write.text(path)
    return tables.scan_id_text(spark, path)


def _article_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "articles")
    docs = I.one_line(I.wide(spark, sf_dir))
    rows = docs.select(
        F.col("doc_id").alias("pii"),
        F.concat(F.lit("On "), "source").alias("title"),
        F.lit("-").alias("c2"),
        X.journal_key(F.col("doc_id")).alias("issn"),
        F.col("source").alias("journal"),
        F.lit("-").alias("c5"),
        F.col("body").alias("abstract"),
        F.lit("-").alias("c7"),
    )
    sinks.save_report(rows, path, header=True)
    return path


@query
def scan_tsv_field(spark, sf_dir):
    return tables.scan_tsv_field(spark, _article_file(spark, sf_dir))


@query
def scan_tsv_titles(spark, sf_dir):
    return tables.scan_tsv_field(spark, _article_file(spark, sf_dir), "title")


@query
def scan_index_articles(spark, sf_dir):
    return search.scan_index_articles(spark, _article_file(spark, sf_dir))


@query
def scan_categories(spark, sf_dir):
    path = fresh_path(spark, "categories")
    rows = I.categories(spark, sf_dir).withColumn("dummy", F.lit(""))
    sinks.save_report(rows, path, header=True)
    return tables.scan_categories(spark, path)


@query
def scan_terms(spark, sf_dir):
    path = fresh_path(spark, "terms")
    I.table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return tables.scan_terms(spark, path)


@query
def load_table(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    I.wide(spark, sf_dir).select("doc_id", "body").write.parquet(path)
    return tables.load_table(spark, path, tables.CORPUS)


@query
def save_roundtrip(spark, sf_dir):
    counts = tokens.token_freq_per_doc(I.wide(spark, sf_dir))
    path = fresh_path(spark, "token-freq")
    return sinks.save_as_table(counts, f"token_freq_{uuid.uuid4().hex}", path)


@query
def saved_tokens(spark, sf_dir):
    """Sentences saved on the way and reloaded as their terms."""
    path = fresh_path(spark, "sentences")
    sinks.save_if(tokens.tokenize_sentences(I.wide(spark, sf_dir)), path)
    return tables.load_tokens(spark, path).select(_words("terms"))


@query
def saved_token_pairs(spark, sf_dir):
    path = fresh_path(spark, "pairs")
    sinks.save_if(tokens.token_pairs(I.wide(spark, sf_dir)), path)
    return tables.load_token_pairs(spark, path)


@query
def saved_categories(spark, sf_dir):
    """Journals with their categories, saved and reloaded under the typed schema."""
    path = fresh_path(spark, "journals")
    journals, _ = _journals(spark, sf_dir)
    sinks.save_if(journals, path)
    return tables.load_categories(spark, path).select("issn", _words("categories"), _words("hot"))


@query
def saved_training(spark, sf_dir):
    """The ids of both sides of a saved training."""
    path = fresh_path(spark, "training")
    train, test = labels.split_by_hash(_label_points(spark, sf_dir))
    classify.save_training(classify.train_and_predict(train, test), path)
    sides = [spark.read.parquet(f"{path}/{side}ing-ids").withColumn("side", F.lit(side)) for side in ("train", "test")]
    return sides[0].unionByName(sides[1])


@query
def xml_fields(spark, sf_dir):
    return xml.extract_xml_fields(I.xml_files(spark, sf_dir))


@query
def xml_ids(spark, sf_dir):
    return xml.extract_xml_fields(I.xml_files(spark, sf_dir), P.XML_ID_FIELDS)


@query
def xml_tree(spark, sf_dir):
    """The same fields, read from a directory tree with one file for each document."""
    root = fresh_path(spark, "xml-tree")
    docs = I.xml_files(spark, sf_dir).withColumn("folder", F.substring(F.md5("path"), 1, 2))
    sinks.save_files(docs.select("x", "folder"), root, "folder")
    found = xml.extract_xml_fields(xml.scan_xml(spark, root, r"\.txt$"))
    return found.drop("file_name")


@query
def dedupe_by_name(spark, sf_dir):
    files = I.xml_files(spark, sf_dir)
    return xml.dedupe_by_name(files).select("file_name", "path")


@query
def report_lines(spark, sf_dir):
    return sinks.report_lines(I.wide(spark, sf_dir), ["doc_id", "source", "body"])


# --- rewriting ------------------------------------------------------------------------


@query
def unglue_heading(spark, sf_dir):
    glued = I.wide(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("Abstract"), "body").alias("body")
    )
    return rewrite.unglue_heading(glued)


@query
def mask_patterns(spark, sf_dir):
    return rewrite.mask_patterns(I.wide(spark, sf_dir)).select("doc_id", "body")


@query
def mask_lexicon(spark, sf_dir):
    docs = I.wide(spark, sf_dir).select("doc_id", "body")
    return seeds.mask_lexicon_and_patterns(docs, I.name_heads(spark, sf_dir))


@query
def filter_masked(spark, sf_dir):
    masked = rewrite.mask_patterns(I.wide(spark, sf_dir))
    return rewrite.filter_masked(masked).select("doc_id")


@query
def extract_matches(spark, sf_dir):
    return rewrite.extract_matches(I.wide(spark, sf_dir), P.NUMBER)


@query
def extract_numerics(spark, sf_dir):
    return rewrite.extract_numerics(I.wide(spark, sf_dir))


# --- seeds and names ------------------------------------------------------------------


@query
def mine_seeds(spark, sf_dir):
    return I.chemical_seeds(spark, sf_dir)


@query
def clean_seeds(spark, sf_dir):
    known = I.dictionary(spark, sf_dir)
    accepted = known.where(F.length("term") > 8)
    return seeds.clean_seeds(I.word_seeds(spark, sf_dir), known, accepted)


@query
def seeds_in_dictionary(spark, sf_dir):
    return seeds.seeds_in_dictionary(I.word_seeds(spark, sf_dir), I.dictionary(spark, sf_dir))


@query
def seed_heads(spark, sf_dir):
    return seeds.seed_heads(I.word_seeds(spark, sf_dir), 6)


@query
def lexicon_matches(spark, sf_dir):
    return seeds.lexicon_matches(I.wide(spark, sf_dir), I.name_heads(spark, sf_dir))


@query
def tag_entities(spark, sf_dir):
    tagged = entities.tag_entities(I.wide(spark, sf_dir), I.entity_lexicon(spark, sf_dir))
    return tagged.select("doc_id", F.inline_outer("tags"))


@query
def entity_context(spark, sf_dir):
    tagged = entities.tag_entities(I.wide(spark, sf_dir), I.entity_lexicon(spark, sf_dir))
    return entities.entity_context(tagged, 10, 5)


@query
def replace_entities(spark, sf_dir):
    tagged = entities.tag_entities(I.wide(spark, sf_dir), I.entity_lexicon(spark, sf_dir))
    return entities.replace_entities(tagged).select("doc_id", "body")


# --- tokens ---------------------------------------------------------------------------


@query
def tokenize_sentences(spark, sf_dir):
    return tokens.tokenize_sentences(I.wide(spark, sf_dir)).select("doc_id", _words("terms"))


@query
def sentence_terms(spark, sf_dir):
    return tokens.sentence_terms(I.wide(spark, sf_dir)).select(_words("terms"))


@query
def terms_lower(spark, sf_dir):
    sentences = tokens.tokenize_sentences(I.wide(spark, sf_dir), "lower")
    return sentences.select("doc_id", _words("terms"))


@query
def token_pairs(spark, sf_dir):
    return tokens.token_pairs(I.wide(spark, sf_dir))


@query
def tokens_per_doc(spark, sf_dir):
    return tokens.tokens_per_doc(I.wide(spark, sf_dir)).select("doc_id", _words("tokens"))


@query
def token_freq_per_doc(spark, sf_dir):
    return tokens.token_freq_per_doc(I.by_id(spark, sf_dir), longer_than=3)


@query
def token_freq_all(spark, sf_dir):
    return tokens.token_freq_per_doc(I.by_id(spark, sf_dir))


@query
def sentence_stems(spark, sf_dir):
    sentences = tokens.tokenize_sentences(I.turns(spark, sf_dir), "lower_stem")
    return sentences.select("doc_id", _words("terms"))


@query
def turn_term_counts(spark, sf_dir):
    """Several rows per id, stop words out."""
    stop = I.dictionary(spark, sf_dir)
    return tokens.pattern_term_counts(I.turns(spark, sf_dir), stop, stemmed=False)


@query
def terms_stem(spark, sf_dir):
    """Every a-z word of the corpus with its stem."""
    words = I.wide(spark, sf_dir).select(F.explode(X.letter_terms(F.col("body"), 1)).alias("term"))
    return tokens.stem_vocabulary(words)


@query
def pattern_term_counts(spark, sf_dir):
    stop = I.dictionary(spark, sf_dir)
    return tokens.pattern_term_counts(I.by_id(spark, sf_dir), stop, stemmed=False)


@query
def stemmed_term_counts(spark, sf_dir):
    stop = I.dictionary(spark, sf_dir)
    return tokens.pattern_term_counts(I.by_id(spark, sf_dir), stop)


@query
def ptb_tokens(spark, sf_dir):
    return tokens.ptb_tokens(I.wide(spark, sf_dir))


@query
def token_shapes(spark, sf_dir):
    """How often each shape occurs."""
    shaped = tokens.token_shapes(tokens.ptb_tokens(I.wide(spark, sf_dir)))
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query
def annotate_tokens(spark, sf_dir):
    return annotate.annotate_tokens(I.wide(spark, sf_dir), I.word_lexicon(spark, sf_dir))


@query
def annotation_lines(spark, sf_dir):
    annotated = annotate.annotate_tokens(I.wide(spark, sf_dir), I.word_lexicon(spark, sf_dir))
    return annotate.annotation_lines(annotated)


@query
def annotate_articles(spark, sf_dir):
    articles = I.articles(spark, sf_dir)
    lexicon = stage(I.word_lexicon(spark, sf_dir), "lexicon")

    def body(field: str) -> DataFrame:
        return articles.select("doc_id", F.col(field).alias("body"))

    return annotate.annotate_articles(
        body("title"), body("abstract"), body("issn"), lexicon
    )


@query
def oov_counts(spark, sf_dir):
    return tokens.oov_counts(I.wide(spark, sf_dir), I.dictionary(spark, sf_dir))


# --- counts and weights ---------------------------------------------------------------


@query
def bow_per_doc(spark, sf_dir):
    return weights.bow_per_doc(tokens.tokenize_sentences(I.turns(spark, sf_dir)))


@query
def doc_freq(spark, sf_dir):
    return weights.doc_freq(I.term_bag(spark, sf_dir))


@query
def doc_count(spark, sf_dir):
    bag = weights.bow_per_doc(tokens.tokenize_sentences(I.turns(spark, sf_dir)))
    return weights.doc_count(bag)


@query
def tfidf(spark, sf_dir):
    bag = I.term_bag(spark, sf_dir)
    freqs = stage(weights.doc_freq(bag), "doc-freq")
    return weights.tfidf(bag, freqs).select("doc_id", "term", _rounded("weight"))


@query
def tfidf_top_terms(spark, sf_dir):
    """The ten heaviest terms of each masked document."""
    masked = rewrite.mask_patterns(I.by_id(spark, sf_dir))
    bag = stage(weights.with_totals(tokens.pattern_term_counts(masked, stemmed=False)), "term-bag")
    freqs = stage(weights.doc_freq(bag), "doc-freq")
    weighted = weights.tfidf(bag, freqs).select("doc_id", "term", _rounded("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    ranked = weighted.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= 10)


@query
def weights_by_term(spark, sf_dir):
    weighted, _ = I.term_weights(spark, sf_dir)
    maps = text_mining.weight_maps(weighted)
    return weights.weights_by_term(maps).select("term", "doc_id", _rounded("weight"))


@query
def sample_rows(spark, sf_dir):
    return weights.sample_by_hash(I.wide(spark, sf_dir), 0.3).select("doc_id")


# --- vectors --------------------------------------------------------------------------


@query
def top_vocabulary(spark, sf_dir):
    freqs = stage(weights.doc_freq(I.term_bag(spark, sf_dir)), "doc-freq")
    return vectors.top_vocabulary(freqs, I.VOCABULARY_SIZE, I.dictionary(spark, sf_dir))


def _lsi_parts(spark: SparkSession, sf_dir: str, size: int):
    """Only the terms of the vocabulary are weighted."""
    bag = I.term_bag(spark, sf_dir)
    freqs = stage(weights.doc_freq(bag), "doc-freq")
    vocabulary = stage(vectors.top_vocabulary(freqs, size), "vocabulary")
    weighted = weights.tfidf(bag, vocabulary.select("term", "df"))
    cells = stage(vectors.term_vectors(weighted, vocabulary), "cells")
    docs = I.corpus(spark, sf_dir).select("doc_id")
    return vocabulary, cells, docs


@query
def term_vectors(spark, sf_dir):
    _, cells, _ = _lsi_parts(spark, sf_dir, I.VOCABULARY_SIZE)
    return cells.select("doc_id", "term_id", _rounded("weight"))


@query
def cooccurrence(spark, sf_dir):
    _, cells, _ = _lsi_parts(spark, sf_dir, I.VOCABULARY_SIZE)
    return lsi.gramian(cells).select("i", "j", _rounded("value"))


@query
def word2vec(spark, sf_dir):
    sentences = spread(tokens.tokenize_sentences(I.wide(spark, sf_dir), "lower"))
    found = vectors.export_word_vectors(vectors.train_word_vectors(sentences))
    return found.select("term", F.size("vec").cast("bigint").alias("dim"), _words("vec"))


@query
def word2vec_vocabulary(spark, sf_dir):
    """The words that have a vector, and its length."""
    sentences = spread(tokens.tokenize_sentences(I.turns(spark, sf_dir), "lower"))
    found = vectors.export_word_vectors(vectors.train_word_vectors(sentences))
    return found.select("term", F.size("vec").cast("bigint").alias("dim"))


def _turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(tokens.tokenize_sentences(I.turns(spark, sf_dir), "lower").select("terms"), "sentences")


@query
def window_counts(spark, sf_dir):
    """How often two words stand within five places of each other."""
    sentences = _turn_sentences(spark, sf_dir)
    return word_vectors.window_counts(sentences, stage(word_vectors.word_counts(sentences), "words"))


@query
def pmi_weights(spark, sf_dir):
    sentences = _turn_sentences(spark, sf_dir)
    counts = word_vectors.window_counts(sentences, stage(word_vectors.word_counts(sentences), "words"))
    weighted = word_vectors.shifted_pmi(stage(counts, "window-counts"), shift=2.0)
    return weighted.select("term", "context", _rounded("weight"))


@query
def pmi_vectors(spark, sf_dir):
    """The words of the corpus that have a vector, and its length."""
    sentences = stage(tokens.tokenize_sentences(I.wide(spark, sf_dir), "lower").select("terms"), "sentences")
    return word_vectors.train(sentences).vectors.select("term", F.size("vec").cast("bigint").alias("dim"))


@query
def join_vectors_weights(spark, sf_dir):
    weighted, freqs = I.term_weights(spark, sf_dir)
    joined = vectors.join_vectors_weights(I.word_vectors(spark, sf_dir, freqs), weighted)
    total = F.reduce("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.select("doc_id", _rounded("weight"), F.round(total, 6).alias("vec_sum"))


@query
def doc_vectors_weighted(spark, sf_dir):
    weighted, freqs = I.term_weights(spark, sf_dir)
    joined = vectors.join_vectors_weights(I.word_vectors(spark, sf_dir, freqs), weighted)
    means = vectors.doc_vectors_weighted(joined)
    return _coordinates(means, "embedding", "doc_id")


def _pairs_and_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    freqs = I.term_freqs(spark, sf_dir)
    return tokens.token_pairs(I.by_id(spark, sf_dir)), I.word_vectors(spark, sf_dir, freqs)


def _mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.doc_vectors_mean(*_pairs_and_vectors(spark, sf_dir))


@query
def doc_vectors_mean(spark, sf_dir):
    return _coordinates(_mean_vectors(spark, sf_dir), "embedding", "doc_id")


@query
def mean_from_sums(spark, sf_dir):
    """The same means by way of the older stored form, count first."""
    sums = vectors.counted_sums(*_pairs_and_vectors(spark, sf_dir))
    means = sums.select("doc_id", vectors.divide_by_count(F.col("embedding")).alias("embedding"))
    return _coordinates(means, "embedding", "doc_id")


def _lsi_model(spark: SparkSession, sf_dir: str):
    vocabulary, cells, docs = _lsi_parts(spark, sf_dir, I.LSI_TERMS)
    return lsi.lsi(cells, I.LSI_TERMS, I.LSI_DIM), vocabulary, cells, docs


@query
def lsi_singular_values(spark, sf_dir):
    """Squared lengths of the columns of A V, which are the squared singular values."""
    model, _, cells, docs = _lsi_model(spark, sf_dir)
    u = lsi.lsi_doc_vectors(cells, docs, model)
    lengths = u.select(F.posexplode("embedding").alias("k", "value"))
    values = F.array(*[F.lit(s) for s in model.singular_values])
    return (
        lengths.groupBy("k")
        .agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
        .select(
            F.col("k").cast("bigint").alias("k"),
            F.round(F.get(values, "k"), 6).alias("singular_value"),
            F.round("norm", 6).alias("u_norm"),
        )
    )


@query
def lsi_doc_vectors(spark, sf_dir):
    """Coordinates of U without their sign, which is not unique."""
    model, _, cells, docs = _lsi_model(spark, sf_dir)
    rows = _coordinates(lsi.lsi_doc_vectors(cells, docs, model), "embedding", "doc_id")
    return rows.select("doc_id", "pos", F.abs("value").alias("value"))


@query
def lsi_term_vectors(spark, sf_dir):
    model, vocabulary, _, _ = _lsi_model(spark, sf_dir)
    rows = _coordinates(lsi.lsi_term_vectors(model, vocabulary), "vec", "term")
    return rows.select("term", "pos", F.abs("value").alias("value"))


def _lengths(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(k, name): the length of each column of a matrix given by its rows."""
    cells = rows.select(F.posexplode(column).alias("k", "value"))
    length = F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6)
    return cells.groupBy("k").agg(length.alias(name))


@query
def lsi_norms(spark, sf_dir):
    """Columns of U = A V / S and of V, of unit length."""
    model, _, cells, docs = _lsi_model(spark, sf_dir)
    u = _lengths(lsi.lsi_doc_vectors(cells, docs, model), "embedding", "u_norm")
    joined = u.join(_lengths(model.v, "vec", "v_norm"), "k")
    return joined.select(F.col("k").cast("bigint").alias("k"), "u_norm", "v_norm")


def _full_lsi(spark: SparkSession, sf_dir: str):
    """All singular values over the most frequent terms."""
    _, cells, docs = _lsi_parts(spark, sf_dir, I.FULL_LSI_TERMS)
    return lsi.lsi(cells, I.FULL_LSI_TERMS, I.FULL_LSI_TERMS), cells, docs


@query
def lsi_energy(spark, sf_dir):
    """The squares of all singular values add up to the trace of AᵀA."""
    model, _, _ = _full_lsi(spark, sf_dir)
    squares = spark.createDataFrame([(s * s,) for s in model.singular_values], "square double")
    return squares.agg(F.round(F.sum("square"), 6).alias("energy"))


@query
def lsi_reconstruction(spark, sf_dir):
    """U S Vᵀ at full rank: the cells of A again."""
    model, cells, docs = _full_lsi(spark, sf_dir)
    u = lsi.lsi_doc_vectors(cells, docs, model)
    scaled = F.array(*[F.get("vec", F.lit(k)) * s for k, s in enumerate(model.singular_values)])
    v = model.v.select("term_id", scaled.alias("scaled"))
    pairs = cells.select("doc_id", "term_id").join(u, "doc_id").join(F.broadcast(v), "term_id")
    value = F.aggregate(F.zip_with("embedding", "scaled", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return pairs.select("doc_id", "term_id", F.round(value, 6).alias("weight"))


# --- categories and labels ------------------------------------------------------------


@query
def category_index(spark, sf_dir):
    return labels.category_index(I.categories(spark, sf_dir))


@query
def key_to_name(spark, sf_dir):
    return labels.key_to_name(I.categories(spark, sf_dir))


def _journals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cats = I.categories(spark, sf_dir)
    index = labels.category_index(cats)
    return labels.multi_hot(cats, index), index


@query
def multi_hot(spark, sf_dir):
    journals, _ = _journals(spark, sf_dir)
    return journals.select("issn", _words("categories"), _words("hot"))


@query
def label_unique(spark, sf_dir):
    labelled = labels.label_unique(I.wide(spark, sf_dir), *_journals(spark, sf_dir))
    return labelled.select("doc_id", "category")


@query
def label_lines(spark, sf_dir):
    labelled = labels.label_unique(_mean_vectors(spark, sf_dir), *_journals(spark, sf_dir))
    return labels.label_lines(labelled, digits=5)


@query
def label_all(spark, sf_dir):
    docs = I.wide(spark, sf_dir).select("doc_id")
    return labels.label_all(docs, *_journals(spark, sf_dir))


@query
def target_index(spark, sf_dir):
    return labels.target_index(I.corpus(spark, sf_dir))


@query
def labeled_points(spark, sf_dir):
    docs = _mean_vectors(spark, sf_dir)
    points = labels.labeled_points(docs, labels.target_index(I.corpus(spark, sf_dir)))
    rows = points.withColumn("x", vector_to_array("features"))
    return _coordinates(rows, "x", "doc_id", "label")


@query
def split_rows(spark, sf_dir):
    docs = I.corpus(spark, sf_dir).select("doc_id")
    train, test = labels.split_by_hash(docs)
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


@query
def split_groups(spark, sf_dir):
    docs = I.corpus(spark, sf_dir).select("doc_id")
    train, test = labels.split_groups(labels.label_all(docs, *_journals(spark, sf_dir)))
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


def _label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(I.table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.col("label").cast("double").alias("label"),
        array_to_vector("embedding").alias("features"),
    )


@query
def predict_labels(spark, sf_dir):
    train, test = labels.split_by_hash(_label_points(spark, sf_dir))
    return classify.train_and_predict(train, test).predictions


@query
def export_vectors(spark, sf_dir):
    issns = I.corpus(spark, sf_dir).select(
        "doc_id", X.journal_key(F.col("doc_id")).alias("body")
    )
    return labels.export_vectors(_mean_vectors(spark, sf_dir), issns, digits=5)


# --- search ---------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> search.SearchIndex:
    documents = search.index_documents(I.articles(spark, sf_dir))
    return search.save_index(documents, fresh_path(spark, "index"))


@query
def build_postings(spark, sf_dir):
    documents = search.index_documents(I.articles(spark, sf_dir))
    spans = F.transform("offsets", lambda o: F.concat_ws("-", o["start"], o["end"]))
    return search.build_postings(documents).select(
        "field", "term", "doc_id", "freq", _words("positions"),
        F.array_join(spans, " ").alias("offsets"), "doc_len",
    )


@query
def index_size(spark, sf_dir):
    return search.index_size(search.index_documents(I.articles(spark, sf_dir)))


@query
def lookup_id(spark, sf_dir):
    return search.lookup_id(_index(spark, sf_dir).documents, "s0000000300000003")


@query
def search_top(spark, sf_dir):
    return search.search(_index(spark, sf_dir), "title", "the station of anderhe, and ing", 20)


@query
def search_batch(spark, sf_dir):
    return search.search_batch(
        _index(spark, sf_dir), I.queries_table(spark, sf_dir), "abstract", 10
    )


@query
def search_hits(spark, sf_dir):
    return search.search_hits(
        _index(spark, sf_dir), I.queries_table(spark, sf_dir), "abstract"
    )


# --- composite jobs -------------------------------------------------------------------


@query
def mined_tfidf(spark, sf_dir):
    """The whole resumable job, entities tagged and masked."""
    mined = text_mining.mine_text(
        spark,
        fresh_path(spark, "mined"),
        I.corpus(spark, sf_dir),
        MiningSettings(tag_entities=True, normalizer="lower"),
        I.entity_lexicon(spark, sf_dir),
    )
    return mined.weights.select("doc_id", "term", _rounded("weight"))


@query
def mined_again(spark, sf_dir):
    """A second run over saved stages: the document frequencies it read back."""
    directory = fresh_path(spark, "mined")
    docs = I.corpus(spark, sf_dir)
    text_mining.mine_text(spark, directory, docs)
    again = text_mining.mine_text(spark, directory, docs)
    if any(action != "read" for _, action in again.log):
        raise RuntimeError(f"a saved stage was built again: {again.log}")
    return again.doc_freq


@query
def masked_sentence_terms(spark, sf_dir):
    docs = I.corpus(spark, sf_dir).select("doc_id", "body")
    terms = text_mining.mask_and_tokenize(
        spark, fresh_path(spark, "masked-terms"), docs, I.name_heads(spark, sf_dir)
    )
    return terms.select(_words("terms"))


@query
def classify_by_word_vectors(spark, sf_dir):
    issns = I.corpus(spark, sf_dir).select(
        "doc_id", X.journal_key(F.col("doc_id")).alias("body")
    )
    bundle = classify_journals.embed_and_classify(
        spark,
        fresh_path(spark, "by-word-vectors"),
        I.corpus(spark, sf_dir),
        issns,
        settings=MiningSettings(normalizer="lower"),
    )
    return bundle.predictions


@query
def classify_by_lsi(spark, sf_dir):
    journals, index = _journals(spark, sf_dir)
    bundle = classify_journals.lsi_and_classify(
        spark,
        fresh_path(spark, "by-lsi"),
        I.corpus(spark, sf_dir),
        journals,
        index,
        MiningSettings(normalizer="lower", vocabulary_size=I.LSI_TERMS, lsi_dim=I.LSI_DIM),
    )
    return bundle.predictions
