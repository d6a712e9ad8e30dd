"""Text rewriting and token shapes as column expressions."""

from __future__ import annotations

import string
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P


def rewrite(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    return reduce(lambda col, rule: F.regexp_replace(col, *rule), rules, text)


def strip_suffix(file_name: Column) -> Column:
    return F.regexp_replace(file_name, P.FILE_SUFFIX, "")


def unglue_heading(text: Column, pattern: str = P.GLUED_HEADING) -> Column:
    """`AbstractThe cat` -> `The cat`; anchored, so at most once."""
    return F.regexp_replace(text, pattern, "$1")


def journal_key(doc_id: Column) -> Column:
    """The eight characters of the id that name its journal."""
    return F.substring(doc_id, 2, 8)


def matches(text: Column, pattern: str) -> Column:
    """All whole matches, in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    return matches(text, P.TOKEN)


def sentences(text: Column) -> Column:
    return matches(text, P.SENTENCE)


def letter_terms(text: Column, min_length: int) -> Column:
    """Lower-case a-z words of at least min_length, each a whole word.

    A run with accented letters or digits is one word and is dropped as a whole.
    """
    word = f"{P.NOT_AFTER_WORD}[a-z]{{{min_length},}}{P.NOT_BEFORE_WORD}"
    return matches(F.lower(text), word)


def treebank_tokens(line: Column) -> Column:
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    spaced = rewrite(padded, P.TREEBANK_RULES)
    return F.filter(F.split(spaced, r"\s+"), lambda token: token != "")


def token_shape(token: Column) -> Column:
    """Alphabetic words stay; numbers and mixed forms collapse to a class.

    Only ASCII is lower-cased and counts as a letter or as a single character.
    """
    bare = F.regexp_replace(token, P.GLUED_ABSTRACT, "$1")
    low = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return (
        F.when(low.rlike(r"^[a-z]+$") | low.rlike(r"^[\x00-\x7F]$"), low)
        .when(low.rlike(r"^[0-9]+$"), F.lit("0"))
        .when(low.rlike(r"^[0-9]"), F.lit("NUM"))
        .when(low.rlike(r"[0-9]"), F.lit("NUMX"))
        .otherwise(F.lit("CPLX"))
    )


def plain_words(text: Column) -> Column:
    """`[a-zA-Z][a-z]+` words with the first letter lower-cased."""
    return F.transform(matches(text, P.PLAIN_WORD), F.lower)


def tag_class(penn_tag: Column) -> Column:
    """Penn tag -> verb, noun, adj, adv or other."""
    result = F.lit(P.OTHER_CLASS)
    for name, tags in P.TAG_CLASSES.items():
        result = F.when(penn_tag.isin(*tags), F.lit(name)).otherwise(result)
    return result


def escape_special(text: Column) -> Column:
    """A token that is itself a delimiter gets a `//` in front."""
    return F.regexp_replace(text, P.ANNOTATION_SPECIALS, "//$1")


def on_one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\t+", " ")
