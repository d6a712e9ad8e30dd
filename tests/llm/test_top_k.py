import random

import numpy as np
import pytest

from lexiflow.llm.top_k import Best, _bounded, search_block, top_k

QUERIES = "query_id long, vector array<long>"
ROWS = "vec_id long, vector array<long>, rank int, score string"


def brute_force(queries, rows, k):
    asked = {}
    for query_id, vector in queries:
        if query_id is not None and vector and None not in vector:
            asked[query_id] = min(asked.get(query_id, vector), vector)
    out = []
    for query_id, q in asked.items():
        found = {
            (-sum(a * b for a, b in zip(q, v)), vec_id)
            for vec_id, v, *_ in rows
            if vec_id is not None and vec_id != query_id and v and None not in v and len(v) == len(q)
        }
        out += [(query_id, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def result(spark, queries, rows, k=5, **options):
    found = top_k(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, ROWS), k, **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("spread", [2, 200])
def test_agrees_with_all_scores(spark, spread):
    draw = random.Random(spread)
    rows = [(i, [int(draw.gauss(0, spread)) for _ in range(12)], 0, "") for i in range(900)]
    queries = [(r[0], r[1]) for r in rows if r[0] % 20 == 0]
    assert result(spark, queries, rows) == brute_force(queries, rows, 5)
    assert result(spark, queries, rows, query_bytes=500) == brute_force(queries, rows, 5)


def test_odd_rows(spark):
    same = [1, 2, 3]
    rows = [(i, same, 0, "") for i in range(30)] + [(30, None, 0, ""), (31, [], 0, ""), (32, [1, None, 3], 0, ""), (None, same, 0, "")]
    rows += [(33, [5, 5], 0, ""), (1, same, 0, ""), (34, [-9, 0, 0], None, None), (35, [10**9, -(10**9), 3], 0, ""), (36, [0, 0, 0], 0, "")]
    queries = [(0, same), (0, same), (7, [0, 0, 0]), (33, [1, 1]), (99, [2]), (None, same), (35, [10**9, -(10**9), 3]), (50, [-1, -1, 0]), (51, None)]
    assert result(spark, queries, rows) == brute_force(queries, rows, 5)
    assert result(spark, [], rows) == [] and result(spark, queries, []) == []
    assert result(spark, queries, rows[:3], k=5) == brute_force(queries, rows[:3], 5)


def test_bounds_rule_out_most_pairs():
    draw = np.random.default_rng(1)
    rows = draw.normal(0, 30, (4000, 16)).astype(np.int64)
    queries, ids = rows[:20], np.arange(4000)
    best = Best(20, 5)
    for block in range(0, 4000, 1000):
        search_block(queries, ids[:20], rows[block : block + 1000], ids[block : block + 1000], best)
    kept, _ = _bounded(queries, ids[:20], rows[:1000], ids[:1000], best)
    assert len(kept) < 0.1 * 20 * 1000


def test_reading_order_does_not_matter():
    draw = np.random.default_rng(2)
    rows = draw.integers(-3, 4, (500, 8))
    ids, order = np.arange(500), draw.permutation(500)
    one, two = Best(5, 5), Best(5, 5)
    search_block(rows[:5], ids[:5], rows, ids, one)
    for part in np.array_split(order, 7):
        search_block(rows[:5], ids[:5], rows[part], ids[part], two)
    assert (one.query == two.query).all() and (one.ids == two.ids).all() and (one.score == two.score).all()
