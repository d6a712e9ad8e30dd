import re
from collections import defaultdict

from lexiflow.llm.mixing import mix, source_targets

SCHEMA = "doc_id long, text string, source string, target string"


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_names, target, left = set(names), {}, sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_names -= over


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_follow_the_weights_and_stop_at_the_limit(spark):
    for sizes in ({"a": 10, "b": 2000, "c": 500, None: 3}, {"a": 0, "b": 9}, {"x": 5}, {"é": 4, "z": 400, "A": 1}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        wanted = fill(sizes)
        assert got.keys() == wanted.keys() and all(abs(got[s] - wanted[s]) < 1e-6 for s in wanted)


def test_words_taken_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{0 if i % 3 else i % 5}", "t") for i in range(3000)]
    taken, targets = defaultdict(int), {}
    got = mix(documents(spark, rows)).collect()
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        targets[r.source] = r.target
    assert len(got) == 3000 and all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 40 for s in targets)
    assert sorted(map(str, got)) == sorted(map(str, mix(documents(spark, rows)).collect()))


def test_plan_is_native(spark):
    plan = mix(documents(spark, [(1, "a", "s", "t")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    rows = [
        (None, "a b", None, "t"), (1, None, "s", None), (2, "", "s", "t"), (2, "", "s", "t"), (3, " \n", None, "t"),
        (4, "x " * 30_000, "s", "t"), (5, "b\x0bc\x1cd e", "s", "t"),
    ]
    got = {(r.doc_id, r.source): (r.size, r.source_size) for r in mix(documents(spark, rows)).collect()}
    assert got[None, None] == (2, 2) and got[4, "s"][0] == 30_000 and got[5, "s"][0] == 2 and got[1, "s"][0] == 0
    assert mix(documents(spark, [])).count() == 0
    assert [r.copies for r in mix(documents(spark, [(1, None, "s", "t")])).collect()] == [0]
