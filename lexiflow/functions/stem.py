"""The Porter (1980) stemmer as column expressions.

The rules are a chain of `transform`s over an array of words. Each step sees its
word as a lambda variable, so the steps do not multiply the expression tree, and
the whole stemmer stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Building blocks of the paper: consonant and vowel runs, and the measure m.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_M_ABOVE_0 = f"^({_C})?{_V}{_C}"
_M_EQUALS_1 = f"^({_C})?{_V}{_C}({_V})?$"
_M_ABOVE_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
_HAS_VOWEL = f"^({_C})?[aeiouy]"
_SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"
_DOUBLE_END = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Suffix tables of the paper, steps 2, 3 and 4.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
_STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)

Step = Callable[[Column], Column]


def _without(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _plural(word: Column) -> Column:
    return (
        F.when(word.rlike("^.+(ss|i)es$"), _without(word, 2))
        .when(word.rlike("^.+[^s]s$"), _without(word, 1))
        .otherwise(word)
    )


def _past(word: Column) -> Column:
    """Past and progressive endings; a trailing `+` marks a removed one."""
    stem = F.regexp_extract(word, "^(.+?)(ed|ing)$", 1)
    return (
        F.when(
            word.rlike("^.+eed$"),
            F.when(_without(word, 3).rlike(_M_ABOVE_0), _without(word, 1)).otherwise(word),
        )
        .when((stem != "") & stem.rlike(_HAS_VOWEL), F.concat(stem, F.lit("+")))
        .otherwise(word)
    )


def _tidy(word: Column) -> Column:
    stem = _without(word, 1)
    return F.when(
        F.endswith(word, F.lit("+")),
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(_DOUBLE_END), _without(stem, 1))
        .when(stem.rlike(_SHORT_END), F.concat(stem, F.lit("e")))
        .otherwise(stem),
    ).otherwise(word)


def _final_y(word: Column) -> Column:
    stem = _without(word, 1)
    return F.when(
        word.rlike("^.+y$") & stem.rlike(_HAS_VOWEL), F.concat(stem, F.lit("i"))
    ).otherwise(word)


def _suffix_step(table: dict[str, str]) -> Step:
    longest = f"^(.+?)({'|'.join(table)})$"
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(word: Column) -> Column:
        stem = F.regexp_extract(word, longest, 1)
        suffix = F.regexp_extract(word, longest, 2)
        return F.when(
            (suffix != "") & stem.rlike(_M_ABOVE_0), F.concat(stem, lookup[suffix])
        ).otherwise(word)

    return step


def _long_suffix(word: Column) -> Column:
    pattern = f"^(.+?)({'|'.join(_STEP_4)})$"
    stem = F.regexp_extract(word, pattern, 1)
    ion_stem = _without(word, 3)
    return (
        F.when(stem != "", F.when(stem.rlike(_M_ABOVE_1), stem).otherwise(word))
        .when(word.rlike("^.+[st]ion$") & ion_stem.rlike(_M_ABOVE_1), ion_stem)
        .otherwise(word)
    )


def _final_e(word: Column) -> Column:
    stem = _without(word, 1)
    drop = stem.rlike(_M_ABOVE_1) | (stem.rlike(_M_EQUALS_1) & ~stem.rlike(_SHORT_END))
    return F.when(word.rlike("^.+e$") & drop, stem).otherwise(word)


def _final_ll(word: Column) -> Column:
    return F.when(word.rlike("ll$") & word.rlike(_M_ABOVE_1), _without(word, 1)).otherwise(word)


def stem_array(words: Column) -> Column:
    """Stem every word; words of one or two letters are left alone.

    A leading y is a consonant, so it is written Y while the rules run.
    """
    steps: list[Step] = [
        _plural,
        _past,
        _tidy,
        _final_y,
        _suffix_step(_STEP_2),
        _suffix_step(_STEP_3),
        _long_suffix,
        _final_e,
        _final_ll,
    ]

    def guarded(step: Step) -> Step:
        return lambda pair: F.struct(
            pair["raw"].alias("raw"),
            F.when(F.length(pair["raw"]) < 3, pair["word"])
            .otherwise(step(pair["word"]))
            .alias("word"),
        )

    state = F.transform(
        words,
        lambda w: F.struct(w.alias("raw"), F.regexp_replace(w, "^y", "Y").alias("word")),
    )
    for step in steps:
        state = F.transform(state, guarded(step))
    return F.transform(state, lambda pair: F.regexp_replace(pair["word"], "^Y", "y"))


def stem(word: Column) -> Column:
    return F.element_at(stem_array(F.array(word)), 1)
