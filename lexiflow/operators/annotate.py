"""Lemma and word-class annotation from a lexicon (term, penn_tag, lemma)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.operators import joins
from lexiflow.operators.joins import lookup_join
from lexiflow.session import stage

SPECIAL = re.compile(P.ANNOTATION_SPECIALS)
# Entries within both bounds go to the texts, as two Arrow columns.
ENTRY_ROWS, ENTRY_BYTES = 4_000_000, 256 * 1024 * 1024
fits_broadcast = partial(joins.fits_broadcast, max_rows=ENTRY_ROWS, max_bytes=ENTRY_BYTES)
TOKENS_AT_ONCE = 1 << 17


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """(term, entry): what follows a token of the lexicon, `|lemma|class|0|0>`; of several the smallest."""
    lemma = X.escape_special(F.coalesce("lemma", "term"))
    entry = F.concat(F.lit("|"), lemma, F.lit("|"), X.tag_class(F.col("penn_tag")), F.lit("|0|0>"))
    return lexicon.where("term is not null").groupBy("term").agg(F.min(entry).alias("entry"))


def _escaped(token: str) -> str:
    return SPECIAL.sub(r"//\1", token)


def annotated_text(tokens: list[str], words: list[str], entries: Mapping[str, str]) -> str:
    """The annotation of one text's tokens, given their lower-cased words."""
    out = []
    for token, word in zip(tokens, words):
        entry = entries.get(word) or f"|{_escaped(word)}|{P.OTHER_CLASS}|0|0>"
        out.append(f"<{_escaped(token)}{entry}")
    return " ".join(out)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def _escaped_all(tokens: pa.Array) -> pa.Array:
    special = pc.match_substring_regex(tokens, r"\A[<>|]\z")
    return pc.if_else(special, pc.binary_join_element_wise("//", tokens, ""), tokens)


def annotated_texts(tokens: pa.Array, words: pa.Array, terms: pa.Array, entries: pa.Array) -> pa.Array:
    """`annotated_text` of lists of tokens and of their words, by columns; a null list gives an empty string."""
    lengths = pc.fill_null(tokens.value_lengths(), 0).to_numpy()
    ends = np.cumsum(lengths, dtype=np.int64)
    tokens, words = tokens.flatten(), words.flatten()
    places = pc.index_in(words, value_set=terms)
    out, at, begin = [], 0, 0
    while at < len(lengths):  # whole texts, of some hundred thousand tokens together
        to = max(at + 1, int(np.searchsorted(ends, begin + TOKENS_AT_ONCE, side="right")))
        end = int(ends[to - 1])
        own = words.slice(begin, end - begin)
        unknown = pc.binary_join_element_wise("|", _escaped_all(own), f"|{P.OTHER_CLASS}|0|0>", "")
        entry = pc.coalesce(entries.take(places.slice(begin, end - begin)), unknown)
        marked = pc.binary_join_element_wise("<", _escaped_all(tokens.slice(begin, end - begin)), entry, "")
        bounds = np.concatenate([[0], ends[at:to] - begin]).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), marked), " "))
        at, begin = to, end
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def annotate_tokens(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, annotated): `<token|lemma|class|0|0>` for every token, space-separated; a row for each of df.

    A token missing from the lexicon is its own lower-cased lemma, of class other. Text
    without tokens gives an empty string.

    The tokens of a text stay together: they are rewritten in place, by a map from words to
    entries. A lexicon of up to ENTRY_ROWS and ENTRY_BYTES is that map, and the texts are read
    as columns. Of a larger one, each document gets the entries of its distinct words, in a join
    on words.
    """
    entries = stage(lexicon_entries(lexicon), "lexicon-entries")
    tokens = X.tokens(F.col("body"))
    rows = df.select("doc_id", tokens.alias("_tokens"), F.transform(tokens, F.lower).alias("_words"))
    if fits_broadcast(entries):
        known = entries.select("term", "entry").toArrow().combine_chunks()  # within the bounds
        shared = df.sparkSession.sparkContext.broadcast([_one(known[name]) for name in ("term", "entry")])

        @F.arrow_udf("string")
        def annotated(tokens: pa.Array, words: pa.Array) -> pa.Array:
            return annotated_texts(tokens, words, *shared.value)

        return rows.select("doc_id", annotated("_tokens", "_words").alias("annotated"))

    @F.arrow_udf("string")
    def annotated_by(tokens: pa.Array, words: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for row in zip(tokens, words, own):  # one text at a time in Python's objects
            t, w, o = (value.as_py() for value in row)
            out.append(annotated_text(t or (), w or (), {e["term"]: e["entry"] for e in o or ()}))
        return pa.array(out, pa.string())

    words = df.select("doc_id", F.explode(F.array_distinct(F.transform(tokens, F.lower))).alias("term")).distinct()
    found = lookup_join(words, entries, "term").groupBy("doc_id")
    found = found.agg(F.collect_list(F.struct("term", "entry")).alias("_own"))
    rows = lookup_join(rows, stage(found, "document-entries"), "doc_id", "left")
    return rows.select("doc_id", annotated_by("_tokens", "_words", "_own").alias("annotated"))


def annotation_lines(annotated: DataFrame) -> DataFrame:
    """`id <tab> 1 <tab> annotation` lines."""
    return annotated.select(F.concat_ws("\t", "doc_id", F.lit("1"), "annotated").alias("value"))


def annotate_articles(
    titles: DataFrame, abstracts: DataFrame, issns: DataFrame, lexicon: DataFrame
) -> DataFrame:
    """(doc_id, issn, title, abstract) with both texts annotated; inner joins on the id.

    The three inputs are (doc_id, body). Inputs partitioned by the id join in place.
    """
    title = annotate_tokens(titles, lexicon).withColumnRenamed("annotated", "title")
    abstract = annotate_tokens(abstracts, lexicon).withColumnRenamed("annotated", "abstract")
    issn = issns.select("doc_id", F.col("body").alias("issn"))
    joined = title.join(abstract, "doc_id").join(issn, "doc_id")
    return joined.select("doc_id", "issn", "title", "abstract")
