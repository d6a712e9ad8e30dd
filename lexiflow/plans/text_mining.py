"""From a corpus to TF-IDF weights, every stage saved and resumable."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.operators import entities, rewrite, seeds, tokens, vectors, weights
from lexiflow.session import fingerprint, remove, scratch, spread
from lexiflow.settings import MiningSettings
from lexiflow.sources.sinks import materialize
from lexiflow.sources.tables import scan_terms


@dataclass
class MinedTables:
    masked: DataFrame  # doc_id, body
    sentences: DataFrame  # doc_id, terms
    bag: DataFrame  # doc_id, term, count
    doc_freq: DataFrame  # term, df
    num_docs: DataFrame  # num_docs
    weights: DataFrame  # doc_id, term, weight
    tagged: DataFrame | None = None
    vocabulary: DataFrame | None = None  # term, df, term_id
    cells: DataFrame | None = None  # doc_id, term_id, weight
    log: list[tuple[str, str]] = field(default_factory=list)
    base: str = ""  # folder of the stages


def stop_word_table(spark: SparkSession, settings: MiningSettings) -> DataFrame | None:
    """The words of the file together with the extra ones."""
    parts = []
    if settings.stop_words_path:
        parts.append(scan_terms(spark, settings.stop_words_path))
    if settings.extra_stop_words:
        rows = [(word,) for word in settings.extra_stop_words]
        parts.append(spark.createDataFrame(rows, "term string"))
    if not parts:
        return None
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.distinct()


def stage_folder(
    directory: str, settings: MiningSettings, corpus: DataFrame, *others: DataFrame | None
) -> str:
    """The folder of the stages of these settings over these tables."""
    prints = [fingerprint(table) for table in (corpus, *others) if table is not None]
    digest = hashlib.sha256("/".join([settings.digest(), *prints]).encode()).hexdigest()[:16]
    return f"{directory.rstrip('/')}/{digest}"


def remove_stages(spark: SparkSession, base: str) -> None:
    """Delete the stages of one folder, as named in MinedTables.base."""
    remove(spark, base)


def mine_text(
    spark: SparkSession,
    directory: str,
    corpus: DataFrame,
    settings: MiningSettings = MiningSettings(),
    lexicon: DataFrame | None = None,
) -> MinedTables:
    """Tag, replace, mask, tokenise, count, weight; each saved stage is read back.

    The folder carries a digest of the settings and fingerprints of the corpus and the
    lexicon, so a run with other ones builds its own stages. `remove_stages` clears them.
    What a stage stores on its way is removed when the stage is written.
    """
    base = stage_folder(directory, settings, corpus.select("doc_id", "body"), lexicon)
    log: list[tuple[str, str]] = []

    def stage(name, build):
        with scratch(spark):
            return materialize(
                spark, f"{base}/{name}", build, lambda action, path: log.append((name, action))
            )

    tagged = None
    source = spread(corpus.select("doc_id", "body"))
    if settings.tag_entities:
        if lexicon is None:
            raise ValueError("tagging needs a lexicon")
        texts = source
        tagged = stage("tagged", lambda: entities.tag_entities(texts, lexicon))
        source = entities.replace_entities(tagged, settings.entity_mask)
    masked = stage("masked", lambda: rewrite.mask_patterns(source, settings.mask_rules))
    sentences = stage(
        "tokenized", lambda: tokens.tokenize_sentences(spread(masked), settings.normalizer)
    )
    bag = stage("bag", lambda: weights.bow_per_doc(spread(sentences)))
    doc_freq = stage("doc-freq", lambda: weights.doc_freq(bag))
    num_docs = stage("num-docs", lambda: weights.doc_count(bag))
    weighted = stage("tfidf", lambda: weights.tfidf(bag, doc_freq, num_docs))
    result = MinedTables(
        masked, sentences, bag, doc_freq, num_docs, weighted, tagged, log=log, base=base
    )
    if settings.build_vectors:
        stop = stop_word_table(spark, settings)
        result.vocabulary = stage(
            "vocabulary",
            lambda: vectors.top_vocabulary(doc_freq, settings.vocabulary_size, stop),
        )
        vocabulary = result.vocabulary
        result.cells = stage("vectors", lambda: vectors.term_vectors(weighted, vocabulary))
    return result


def mask_and_tokenize(
    spark: SparkSession, directory: str, corpus: DataFrame, heads: DataFrame
) -> DataFrame:
    """The older job: names and numbers masked and saved, then sentence terms saved."""
    with scratch(spark):
        masked = materialize(
            spark,
            f"{directory}/replacement",
            lambda: seeds.mask_lexicon_and_patterns(spread(corpus), heads).select("doc_id", "body"),
        )
    return materialize(
        spark, f"{directory}/tokenized", lambda: tokens.sentence_terms(spread(masked))
    )


def weight_maps(weighted: DataFrame) -> DataFrame:
    """(doc_id, weights): the long table as one map per document."""
    return tokens.counts_as_map(weighted, "term", "weight").select(
        "doc_id", F.col("weights")
    )
