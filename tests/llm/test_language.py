import math
import random
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest

from lexiflow.llm.language import (
    UNKNOWN, Pieces, expected_uses, held_out, keep_known_languages, log_chances, predict, split_words, train,
)
from lexiflow.llm.vocabulary import MARK, PIECES

pytestmark = pytest.mark.skipif(not Path(PIECES).exists(), reason="no public vocabulary")
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
NAMES = [MARK, MARK + "a", "a", "ab", "b", "abc", "é", MARK + "ab", "bc"]


def table():
    pieces = Pieces(NAMES)
    chances = np.random.default_rng(0).random((2, len(NAMES)))
    return pieces, np.hstack([chances / chances.sum(axis=1, keepdims=True), np.zeros((2, 1))])


def segmentations(word):
    """All ways to cut a word."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        for rest in segmentations(word[n:]):
            yield (word[:n], *rest)


def chance_of(pieces, chances, parts, language):
    out = 1.0
    for part in parts:
        if part in pieces.names:
            out *= chances[language, pieces.names.index(part)]
        else:
            out *= UNKNOWN if len(part) == 1 else 0.0
    return out


def test_forward_sums_all_segmentations():
    pieces, chances = table()
    found = split_words("Abcab é, abz a".encode() and ["Abcab é, abz a".encode()])
    logs = log_chances(found, pieces, chances)
    spelled = [found.spelled[s : s + n].tobytes().decode("utf-32-le") for s, n in zip(found.starts, found.lengths)]
    assert sorted(spelled) == ["a", "abcab", "abz", "é"]
    for language in (0, 1):
        for word, log in zip(spelled, logs[language]):
            total = sum(chance_of(pieces, chances, parts, language) for parts in segmentations(MARK + word))
            assert log == pytest.approx(math.log(total))


def test_expected_uses_weigh_segmentations():
    pieces, chances = table()
    found = split_words([b"abcab ab"])
    counts = np.array([3.0, 2.0])
    uses = expected_uses(found, pieces, chances[:1], counts)
    wanted = dict.fromkeys(NAMES, 0.0)
    for s, n, count in zip(found.starts, found.lengths, counts):
        word = MARK + found.spelled[s : s + n].tobytes().decode("utf-32-le")
        cuts = [(parts, chance_of(pieces, chances, parts, 0)) for parts in segmentations(word)]
        total = sum(c for _, c in cuts)
        for parts, c in cuts:
            for part in parts:
                if part in wanted:
                    wanted[part] += count * c / total
    assert [wanted[n] for n in pieces.names] == pytest.approx(list(uses))


def labelled(n, seed=1):
    draw = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "de": ["sch", "ung", "der", "ein", "ä"], "el": ["και", "το", "ς", "η"]}
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(parts))
        words = ("".join(draw.choices(parts[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(3, 40)))
        rows.append((i, " ".join(words).capitalize() + ".", lang, "x", 1))
    return rows


def test_held_out_texts_are_recognised(spark):
    docs = spark.createDataFrame(labelled(300), SCHEMA)
    model = train(docs.filter(~held_out(5)))
    got = predict(docs.filter(held_out(5)), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


@lru_cache
def odd_rows():
    return [(1000, None, "en", "x", 1), (1001, "", None, None, None), (1002, "12 — !?", "de", "x", 1), (None, "the thing", None, "x", 1),
            (1003, "schung" * 30_000, "de", "x", 1), (1004, "漢字" * 100, None, "x", 1), (1003, "schung", "de", "x", 1)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(labelled(200) + odd_rows(), SCHEMA)
    got = {r.doc_id: r for r in predict(docs, train(docs.filter(~held_out(5)))).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "en" and got[1003].lang_pred == "de" and got[1004].lang_pred in ("en", "de", "el")
    assert predict(spark.createDataFrame([], SCHEMA), train(docs)).count() == 0
    unlearned = predict(docs, train(docs.filter("lang = 'none'"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlearned] == [("und", 0.0)]


def test_stage_drops_undetermined_rows_only(spark):
    docs = spark.createDataFrame([r[:3] for r in labelled(200) + odd_rows()], "doc_id long, text string, lang string")
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == 204


def test_training_is_bounded_by_its_parameter(spark):
    docs = spark.createDataFrame(labelled(400), SCHEMA)
    assert train(docs, rows=100).languages == ["de", "el", "en"]
