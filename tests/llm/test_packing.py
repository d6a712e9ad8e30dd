import random
import zlib

import numpy as np
import pytest

from lexiflow.llm import packing as K

DOCS = "doc_id long, text string, piece string, length int"


def unpack(solution):
    return [x for filling, times in solution for x in filling * times]


def fewest(lengths, capacity):
    """Exact, by trying every place for each piece."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[i] and room[j] not in room[:j]:
                place(i + 1, room[:j] + [room[j] - lengths[i]] + room[j + 1 :])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_fewest_sequences(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1 + seed % 4 * 4, 20) for _ in range(11)]
    counts = np.bincount(lengths, minlength=31)
    solution = K.complete(counts, 30)
    assert sorted(unpack(solution)) == sorted(lengths) and all(sum(f) <= 30 for f, _ in solution)
    assert sum(t for _, t in solution) == fewest(lengths, 30) >= K.lower_bound(counts, 30)


def test_better_than_best_fit():
    """Where best-fit needs one more, the search finds the exact fillings."""
    counts = np.bincount([6, 6, 4, 4, 4, 3, 3] * 50, minlength=11)
    assert K.lower_bound(counts, 10) == 150 == sum(t for _, t in K.complete(counts, 10))
    counts = np.bincount([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], minlength=61)
    assert sum(t for _, t in K.best_fit(counts, 60)) == 4 and sum(t for _, t in K.complete(counts, 60)) == 3


@pytest.mark.parametrize("nodes", [0, 1, 50, K.NODES])
def test_whole_with_any_number_of_nodes(nodes):
    draw = np.random.default_rng(nodes)
    counts = np.zeros(201, int)
    counts[draw.integers(1, 201, 60)] = draw.integers(1, 10**9, 60)
    solution = K.complete(counts, 200, nodes)
    got = np.zeros(201, int)
    for filling, times in solution:
        assert sum(filling) <= 200
        for length in filling:
            got[length] += times
    assert (got == counts).all()
    assert K.lower_bound(counts, 200) <= sum(t for _, t in solution) <= sum(t for _, t in K.best_fit(counts, 200))


def test_dominance():
    assert K.dominates((5, 4), (4, 3, 1)) and K.dominates((5,), (3, 2)) and K.dominates((3, 3), (3, 3))
    assert not K.dominates((4, 3), (5, 1)) and not K.dominates((3, 2), (5,))
    counts = np.bincount([7, 5, 4, 3, 2, 1], minlength=11)
    assert K.fillings(counts, 7, 4) == [(7,)]  # dominates all others
    assert set(K.fillings(counts, 8, 4)) == {(7, 1), (5, 3)}
    assert counts.tolist() == np.bincount([7, 5, 4, 3, 2, 1], minlength=11).tolist()
    assert K.fillings(np.bincount([1] * 3000, minlength=2049), 2047, 4) == [(1,) * 2047]


ODD_TEXTS = [
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's 'station don't I'LL ’s", "a\x0bb\x85c\xa0d e\x1cf", "ΟΔΟΣ ΣΑΣ. Σ",
    "²½ⅷ x² 3½", "éa ́b ≮", "한국어, 日本語。", "12,34-5%% ---a", "ẞ İstanbul ŒUVRE", "\r\n\t ", "a_b_c __", "x" * 5000,
    "𝒳 😀😀a", "", "\x00\x01a\x02", "a‍b", "ﬁ ǅ ªº", "Ⅷa aⅧ", "a:'b n'",
]


def test_ids_by_parts_are_those_of_the_whole_text(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(K.TOKENIZER)
    draw = random.Random(4)
    letters = "abcXYZéßΣ'’.,;<|>%1²½ \t\n\r\x0b\xa0́日"
    texts = ODD_TEXTS + ["".join(draw.choices(letters, k=draw.randint(1, 300))) for _ in range(300)]
    encoder = K.Encoder(K.TOKENIZER)
    monkeypatch.setattr(K, "KNOWN_PARTS", 100)
    for part in ([t] for t in texts), [texts], [texts[::-1]]:
        for group in part:
            for text, ids in zip(group, encoder(group)):
                assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(K.TOKENIZER)
    wanted = []
    for doc_id, text, *_ in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted.append((-1 if doc_id is None else doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got) == sorted(wanted)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    counts = np.bincount([w[3] for w in wanted], minlength=capacity + 1)
    assert len(sequences) <= sum(t for _, t in K.best_fit(counts, capacity))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(spark, capacity):
    draw = random.Random(1)
    docs = [(i, " ".join(draw.choices(["a", "station", "wordy,", "zzyzx"], k=draw.randint(1, 40))), "x", 1) for i in range(120)]
    docs += [(7, "same text", "x", 1)] * 60 + [(None, None, None, None), (None, "", None, 3), (500, "a " * 5000, "", 0)]
    rows = K.pack(spark.createDataFrame(docs, DOCS).repartition(5), capacity).collect()
    check(rows, docs, capacity)


def test_empty_table(spark):
    assert K.pack(spark.createDataFrame([], DOCS)).collect() == []
