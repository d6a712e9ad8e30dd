import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F

from lexiflow.llm.catalog import op4_scoring
from lexiflow.llm.language import held_out
from lexiflow.llm.scoring import (
    ASK,
    BUCKETS,
    Answers,
    Grams,
    _answer,
    _ask,
    _ask_open,
    _names,
    corpus_size,
    count_grams,
    learn_weights,
    score,
    squeeze,
    squeeze_sorted,
    unsqueeze,
    unsqueeze_sorted,
)

SCHEMA = "doc_id long, text string, counts string, block int"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["<end>"]


def trains(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0


def brute_force(rows, order, weights):
    """Scores from dictionaries of all n-grams, with the given mixture weights."""
    grams = [Counter() for _ in range(order)]
    padded = lambda text: ["<begin>"] * (order - 1) + tokens(text)
    for doc_id, text, *_ in rows:
        if trains(doc_id):
            line = padded(text)
            for i in range(order - 1, len(line)):
                for n in range(order):
                    grams[n][tuple(line[i - n : i + 1])] += 1
    contexts = Counter()
    for n in range(1, order):
        for gram, count in grams[n].items():
            contexts[gram[:-1]] += count
    total, distinct = sum(grams[0].values()), len(grams[0])
    out = []
    for doc_id, text, *_ in rows:
        line, known, base, mixed = padded(text), 0, 0.0, 0.0
        for i in range(order - 1, len(line)):
            count = grams[0][(line[i],)]
            known += count > 0
            base += math.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
            estimates, bucket = [1 / (distinct + 1), count / total if total else 0.0], 0
            for n in range(1, order):
                context = contexts[tuple(line[i - n : i])]
                estimates.append(grams[n][tuple(line[i - n : i + 1])] / context if context else 0.0)
                if context:
                    bucket = n * BUCKETS + min(int(math.log2(context)), BUCKETS - 1)
            mixed += math.log10(sum(w * e for w, e in zip(weights[bucket], estimates)))
        out.append((doc_id, not trains(doc_id), len(line) - order + 1, known, total, base, mixed))
    return out


def documents(n, seed=2):
    draw = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    rows = []
    for i in range(n):
        word, out = 0, []
        for _ in range(draw.randint(0, 60)):
            word = (word * 7 + draw.choice([1, 1, 1, 5, draw.randrange(60)])) % 60
            out.append(vocabulary[word])
        rows.append((i, " ".join(out), "x", 1))
    return rows


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_agrees_with_dictionaries(spark, order):
    rows = documents(150) + [(500, None, None, None), (500, None, None, None), (None, "\x0b A\x1cb ", "x", 1), (7, "w1 " * 40_000, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counted = count_grams(docs, ~held_out(10), order)
    weights = learn_weights(counted, order, *corpus_size(counted))
    got = sorted((tuple(r) for r in score(docs, ~held_out(10), order).collect()), key=str)
    for mine, other in zip(got, sorted(brute_force(rows, order, weights), key=str), strict=True):
        assert mine[:5] == other[:5]
        assert mine[5:] == pytest.approx(other[5:], rel=1e-9, abs=1e-9)


def test_weights_sum_to_one_and_context_helps_on_held_out_texts(spark):
    docs = spark.createDataFrame(documents(600), SCHEMA)
    held = score(docs, ~held_out(10)).filter("held_out")
    base, mixed = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert mixed > base + 100
    counted = count_grams(docs, ~held_out(10))
    assert learn_weights(counted, 2, 1000, 60).sum(axis=1) == pytest.approx(1)


def test_size_of_blocks_changes_no_count(spark):
    docs = spark.createDataFrame(documents(80), SCHEMA)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    one = sorted(map(tuple, score(docs, ~held_out(10)).select(columns).collect()))
    many = sorted(map(tuple, score(docs, ~held_out(10), block_chars=200).select(columns).collect()))
    assert one == many


def test_longer_grams_are_asked_only_if_shorter_parts_are_shared():
    zstd = zstandard.ZstdCompressor().compress

    def block(number, texts, trained):
        return pa.table({"block": [number], "doc_id": [[0]], "trained": [trained], "sizes": [[len(t) for t in texts]], "bodies": [zstd(b"".join(texts))]})

    texts = {0: [b"a b c d e", b"x y z"], 1: [b"q a b c r"]}
    trained = {0: [True, True], 1: [False]}
    packs = {n: block(n, texts[n], trained[n]) for n in texts}
    first = pa.concat_tables(_ask(3, 1)(p) for p in packs.values())
    answers = pa.concat_tables(_answer(first.filter(pc.equal(first["question"], q))) for q in (0, 1))
    mine = {n: answers.filter(pc.equal(answers["block"], n)) for n in texts}
    second = {n: _ask_open(2, 1)(packs[n], mine[n]) for n in texts}
    keys = {n: len(np.concatenate([unsqueeze_sorted(k) for k in t["keys"].to_pylist()] or [[]])) for n, t in second.items()}
    assert keys == {0: 1, 1: 1}  # a b c alone: the pairs a b and b c stand in both blocks
    answered = _answer(pa.concat_tables(second.values()))
    for n in texts:
        grams = Grams(texts[n], np.array(trained[n]), 3)
        both = Answers(grams, pa.concat_tables([mine[n], answered.filter(pc.equal(answered["block"], n))]), 1)
        *_, (question, keys, at, own, asked) = both.orders(range(3))
        total = both.totals(question, own, asked)[at]
        assert total.sum() == (10 if n == 0 else 1) and both.shared(question, keys, asked).sum() == 1


def test_nothing_to_learn_from(spark):
    assert score(spark.createDataFrame([], SCHEMA), ~held_out(10)).count() == 0
    alone = score(spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA), F.lit(False)).first()
    assert (alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (0, 0, 0.0, pytest.approx(alone.score)) and alone.score < 0


def test_the_query_uses_trigrams(spark, tmp_path):
    docs = spark.createDataFrame(documents(60), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.score) for r in op4_scoring(spark, str(tmp_path)).collect())
    wanted = sorted((r.doc_id, r.score) for r in score(docs, ~held_out(10), order=3).collect())
    assert [i for i, _ in got] == [i for i, _ in wanted]
    assert [x for _, x in got] == pytest.approx([x for _, x in wanted], rel=1e-9)


def test_totals_beyond_32_bits():
    keys, most = np.array([7, 9], np.uint64), np.array([2**32 - 1, 1], np.uint32)
    rows = [(0, 0, block, squeeze_sorted(keys), squeeze(most)) for block in range(3)]
    asked = pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], names=_names(ASK))
    for packed in _answer(asked).column("counts").to_pylist():
        assert unsqueeze(packed, np.int64).tolist() == [3 * (2**32 - 1), 3]
