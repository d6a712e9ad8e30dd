import random

import numpy as np
import pytest

from lexiflow.llm import hard_negatives as H

ANCHORS = "anchor_id long, label int, vector array<long>, slot string"
ROWS = "vec_id long, label int, vector array<long>, score string, heads int"


def brute_force(anchors, rows, n_pos=5, n_neg=3):
    asked = {}
    for i, label, vector, *_ in anchors:
        if i is not None and label is not None and vector is not None and None not in vector:
            asked[i] = min(asked.get(i, (label, vector)), (label, vector))
    good = {(i, y, tuple(v)) for i, y, v, *_ in rows if i is not None and y is not None and v is not None and None not in v}
    out = []
    for a, (label, vector) in asked.items():
        scored = [(-sum(x * z for x, z in zip(vector, v)), i, y) for i, y, v in good if len(v) == len(vector)]
        pos = sorted({(s, i) for s, i, y in scored if y == label and i != a})[:n_pos]
        for s, p in pos:
            inside = sorted({(t, i) for t, i, y in scored if y != label and 50 * -s <= 100 * -t <= 95 * -s})
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


def result(spark, anchors, rows, **options):
    found = H.hard_negatives(spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(rows, ROWS), **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("spread", [2, 300])
def test_agrees_with_all_windows(spark, spread):
    draw = random.Random(spread)
    rows = [(i, draw.randrange(4), [int(draw.gauss(0, spread)) for _ in range(8)], "", 0) for i in range(600)]
    anchors = [(i, y, v, "") for i, y, v, *_ in rows if i % 25 == 0]
    wanted = brute_force(anchors, rows)
    assert len(wanted) > 100
    assert result(spark, anchors, rows) == wanted
    assert result(spark, anchors, rows, anchor_bytes=400) == wanted
    assert result(spark, anchors, rows, positives=2, negatives=1) == brute_force(anchors, rows, 2, 1)


def test_odd_rows(spark):
    ones = [1, 1]
    rows = [(i, i % 2, [i % 3, 5], "", 0) for i in range(40)]
    rows += [rows[3], rows[3], (100, None, ones, "", 0), (101, 1, None, "", 0), (102, 1, [1, None], "", 0), (None, 1, ones, "", 0)]
    rows += [(103, 0, [], "", 0), (104, 0, [], "", 0), (105, 1, [], "", 0), (106, 0, [10**9, 10**8], None, None), (107, 1, [9 * 10**8, 0], None, None)]
    rows += [(3, 0, [4, 4], "", 0), (108, 0, [-5, -5], "", 0)]
    anchors = [(0, 0, [0, 5], ""), (0, 0, [0, 5], ""), (3, 1, [0, 5], ""), (200, 7, ones, ""), (103, 0, [], ""), (108, 0, [-5, -5], "")]
    anchors += [(None, 0, ones, ""), (201, None, ones, ""), (202, 0, None, ""), (203, 0, [None], ""), (106, 0, [10**7, 10**7], "")]
    wanted = brute_force(anchors, rows)
    assert {r[0] for r in wanted} == {3, 103, 106}
    assert result(spark, anchors, rows) == wanted
    assert result(spark, [], rows) == [] and result(spark, anchors, []) == []


def test_tasks_send_a_few_rows_of_each_slot():
    """Any order and cut of the rows leaves the same heads, never more than k of a group."""
    draw = np.random.default_rng(3)
    group, score, ids = draw.integers(0, 20, 5000), draw.integers(0, 50, 5000), np.arange(5000)
    one, two = H.Heads(20, 3), H.Heads(20, 3)
    one.add(group, score, ids)
    for part in np.array_split(draw.permutation(5000), 9):
        two.add(group[part], score[part], ids[part])
        two.merge()
    for a, b in zip(one.merge(), two.merge()):
        assert (a == b).all()
    assert np.bincount(one.kept[0]).max() == 3


def test_slots_are_disjoint_and_cover_the_windows():
    class Row:
        anchor_id, label, vector = 1, 0, [1]

    block = H.Anchors([Row])
    block.set_limits(np.array([[95, 76, 76 - 38, np.iinfo(np.int64).min]]), np.array([20]))
    scores = np.arange(0, 120)[None, :]
    group, score, _ = H._in_slots(block, np.array([0]), scores, np.zeros((1, 120), bool), np.arange(120))
    assert score.min() == 20 and score.max() == 95
    assert [(score[group == g].min(), score[group == g].max()) for g in range(3)] == [(77, 95), (39, 76), (20, 38)]
