import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiflow.llm.words import pieces, row_hashes, shingles, span_hashes, words

texts = st.lists(st.binary(max_size=60).map(lambda b: b.replace(b"\0", b" ")), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_runs_outside_white_space(found):
    owner, hashes = words(found) if found else (np.zeros(0), np.zeros(0))
    plain = [(i, w) for i, t in enumerate(found) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert list(owner) == [i for i, _ in plain]
    same = {}
    for (_, word), value in zip(plain, hashes):
        assert same.setdefault(word, value) == value
    assert len(set(same.values())) == len(same)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"cc", b"A"]), max_size=12))
def test_shingles(parts):
    lowered = [p.lower() for p in parts]
    wanted = {tuple(lowered[i : i + 5]) for i in range(len(parts) - 4)} if len(parts) >= 5 else {tuple(lowered)} if parts else set()
    assert len(shingles([b" ".join(parts)], 5)[0]) == len(wanted)


def test_hash_of_a_span_does_not_depend_on_its_place():
    values = np.frombuffer(b"xxabcabc", np.uint8)
    a, b = span_hashes(values, np.array([2, 5]), np.array([5, 8]))
    assert a == b == row_hashes(values[2:5][None, :])[0]


def test_pieces_keep_order_and_long_texts_whole():
    given_texts = [b"a" * 10, None, b"b" * 500, b"", b"c"]
    out = list(pieces(given_texts, 100))
    assert [t for _, p in out for t in p] == [b"a" * 10, b"", b"b" * 500, b"", b"c"]
    assert [first for first, _ in out] == [0, 2, 3]
