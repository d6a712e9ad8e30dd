"""Masking and pattern extraction over (doc_id, body)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X


def unglue_heading(df: DataFrame, pattern: str = P.GLUED_HEADING) -> DataFrame:
    return df.withColumn("body", X.unglue_heading(F.col("body"), pattern))


def mask_patterns(
    df: DataFrame, rules: Iterable[tuple[str, str]] = P.MASK_RULES
) -> DataFrame:
    """Percentages, comparisons, numbers and parentheses, in that order."""
    return df.withColumn("body", X.rewrite(F.col("body"), rules))


def mask_numbers_after_names(df: DataFrame, paren_replacement: str = "") -> DataFrame:
    """The older number rules, for bodies in which names are already masked.

    Text glued to the front of a name mask is dropped; white space is left alone.
    `paren_replacement` may be a mask instead of nothing.
    """
    return mask_patterns(df, (*P.LEXICON_MASK_RULES, (P.PAREN, paren_replacement)))


def filter_masked(
    df: DataFrame,
    masks: Sequence[str] = (
        P.ENTITY_MASK,
        P.PERCENT_MASK,
        P.COMPARISON_MASK,
        P.NUMBER_MASK,
        P.PAREN_MASK,
    ),
) -> DataFrame:
    """Documents that received a mask.

    The generator keeps the filter above the rewriting of the body. Pushed below, it
    would repeat all the rewriting for every row.
    """
    others = [name for name in df.columns if name != "body"]
    once = df.select(*others, F.explode(F.array("body")).alias("body"))
    return once.where(F.col("body").rlike("|".join(masks))).select(*df.columns)


def extract_matches(df: DataFrame, pattern: str) -> DataFrame:
    """Every match, one row each, duplicates kept."""
    found = F.explode(X.matches(F.col("body"), pattern))
    return df.select("doc_id", found.alias("match"))


def extract_numerics(df: DataFrame) -> DataFrame:
    """(sign, number, unit) of every quantity.

    The text is searched once; the groups are then cut out of each short match.
    """
    part = [F.regexp_extract("match", P.QUANTITY, i) for i in (1, 2, 3)]
    return extract_matches(df, P.QUANTITY).select(
        "doc_id", part[0].alias("sign"), part[1].alias("number"), part[2].alias("unit")
    )
