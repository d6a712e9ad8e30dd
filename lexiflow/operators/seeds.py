"""Mining of chemical-name seeds and the names that begin with them."""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.operators.joins import fits_broadcast, lookup_join
from lexiflow.operators.rewrite import extract_matches, mask_numbers_after_names
from lexiflow.session import stage


def mine_seeds(df: DataFrame, min_length: int = 4) -> DataFrame:
    """Letter fragments of `...2,4-word` shapes; distinct (seed)."""
    shapes = extract_matches(df, P.SEED_SHAPE).select("match").distinct()
    fragment = F.explode(X.matches(F.col("match"), P.SEED_FRAGMENT))
    return (
        shapes.select(fragment.alias("seed"))
        .where(F.length("seed") >= min_length)
        .distinct()
    )


def _common_words(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.lower("term").alias("seed")).distinct()


def clean_seeds(seeds: DataFrame, dictionary: DataFrame, accepted: DataFrame) -> DataFrame:
    """Seeds that are no common word, unless accepted, and only Latin or Greek letters."""
    allowed = accepted.select(F.col("term").alias("seed"))
    excluded = _common_words(dictionary).join(allowed, "seed", "left_anti")
    return seeds.join(excluded, "seed", "left_anti").where(
        ~F.col("seed").rlike(P.NOT_LATIN_GREEK)
    )


def seeds_in_dictionary(seeds: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Seeds that are also common words: candidates for the accepted list."""
    return seeds.join(_common_words(dictionary), "seed", "left_semi")


def seed_heads(seeds: DataFrame, length: int = 10) -> DataFrame:
    return seeds.select(F.substring("seed", 1, length).alias("head")).distinct()


# --- names by spans -------------------------------------------------------------------

HEADER = re.compile(P.LOCANT_HEADER, re.ASCII)
TAIL = re.compile(f"[a-zA-Z]*{P.LOCANT_TRAILER}", re.ASCII)


def name_spans(body: str, heads: Container[str], longest: int) -> list[tuple[int, int]]:
    """(start, end) of every name: a locant header, a head at its end or inside it, the rest.

    The header is one run of marks; the last place of the run where a head begins decides for
    all starts in it, so a text is read once.
    """
    spans, at = [], 0
    while header := HEADER.search(body, at):
        start, end = header.span()
        place, length = end, 0
        while place > start:
            most = min(longest, len(body) - place)
            length = next((n for n in range(1, most + 1) if body[place : place + n] in heads), 0)
            if length:
                break
            place -= 1
        if length:
            end = TAIL.match(body, place + length).end()
            spans.append((start, end))
        at = end
    return spans


def _masked(body: str, spans: list[tuple[int, int]], mask: str) -> str:
    ends = [0, *(end for _, end in spans)]
    return mask.join([*(body[a:start] for a, (start, _) in zip(ends, spans)), body[ends[-1] :]])


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """Rows of a batch, one at a time: Python's objects of a whole batch are some times its size."""
    return (tuple(value.as_py() for value in row) for row in zip(*columns))


def _with_heads(df: DataFrame, heads: DataFrame, length: int) -> tuple[DataFrame, Callable]:
    """df, and the set of heads for each of some rows: a shared one, or that of a column `_heads`.

    Heads within the broadcast bounds go to the texts. Of more, each document gets those that
    can match: the first letters at every place where a name can begin, at every length, meet
    the heads in a join.
    """
    heads = stage(heads.select("head").where("head <> ''").distinct(), "heads")
    if fits_broadcast(heads):
        known = frozenset(row.head for row in heads.collect())  # within the bounds
        shared = df.sparkSession.sparkContext.broadcast(known)
        return df.withColumn("_heads", F.lit(None).cast("array<string>")), lambda own: shared.value
    found = _candidates(df, length)
    found = lookup_join(found, heads, "head", "left_semi").groupBy("doc_id").agg(F.collect_list("head").alias("_heads"))
    return df.join(found, "doc_id", "left"), lambda own: frozenset(own or ())


def _candidates(df: DataFrame, length: int) -> DataFrame:
    """(doc_id, head): what can be a head, of every length, in or right after a locant header."""
    shapes = df.select(
        "doc_id", F.explode(F.array_distinct(X.matches(F.col("body"), P.NAME_SHAPE))).alias("shape")
    )
    header_end = F.length(F.regexp_extract("shape", f"^{P.LOCANT_HEADER}", 0))
    begins = F.filter(
        F.sequence(F.lit(2), header_end + 1), lambda p: F.substr("shape", p, F.lit(1)).rlike(P.LETTER)
    )
    runs = F.transform(
        begins, lambda p: F.regexp_extract(F.substr("shape", p, F.lit(length)), f"^{P.LETTER}+", 0)
    )
    run = shapes.select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    first = F.transform(F.sequence(F.lit(1), F.length("run")), lambda n: F.substr("run", F.lit(1), n))
    return run.select("doc_id", F.explode(first).alias("head")).distinct()


def lexicon_matches(df: DataFrame, heads: DataFrame, length: int = 10) -> DataFrame:
    """Distinct names found in the corpus; heads are letters, `length` at most."""
    rows, known = _with_heads(df.select("doc_id", "body"), heads, length)

    @F.arrow_udf("array<string>")
    def names(bodies: pa.Array, heads: pa.Array) -> pa.Array:
        rows = _rows(bodies, heads)
        return pa.array(([b[x:y] for x, y in name_spans(b or "", known(own), length)] for b, own in rows), pa.list_(pa.string()))

    return rows.select(F.explode(names("body", "_heads")).alias("match")).distinct()


def mask_names(df: DataFrame, heads: DataFrame, length: int = 10) -> DataFrame:
    """df with every name in body replaced by the entity mask; heads are letters, `length` at most."""
    rows, known = _with_heads(df, heads, length)

    @F.arrow_udf("string")
    def masked(bodies: pa.Array, heads: pa.Array) -> pa.Array:
        rows = _rows(bodies, heads)
        out = (b and _masked(b, name_spans(b, known(own), length), P.ENTITY_MASK) for b, own in rows)
        return pa.array(out, pa.string())

    return rows.withColumn("body", masked("body", "_heads")).drop("_heads")


def mask_lexicon_and_patterns(
    df: DataFrame, heads: DataFrame, paren_replacement: str = "", length: int = 10
) -> DataFrame:
    """The older masking: names first, then the number rules."""
    return mask_numbers_after_names(mask_names(df, heads, length), paren_replacement)
