import random
import re
from itertools import combinations

from lexiflow.llm.graph import components
from lexiflow.llm.near_dedup import drop_near_duplicates, most_differing_bits, near_duplicates

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        known = [x for x in (least.get(find(i)), row[0]) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(
        ((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str
    )


def variants(seed, groups, copies, edits):
    """Groups of texts, each edited a little further from the one before."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(20, 200))]
        for _ in range(draw.randint(1, copies)):
            words = list(words)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append(" ".join(words))
    draw.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_agrees_with_all_pairs(spark):
    rows = variants(3, 60, 8, 3)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert result(found) == brute_force(rows)


def test_chain_in_one_bucket_is_linked_through(spark):
    draw = random.Random(1)
    words = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(40):  # neighbours are similar, the ends are not
        rows.append((i, " ".join(words), "s"))
        words = words[2:] + [f"y{draw.random()}", f"z{i}"]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert result(found) == brute_force(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "", "s"), (3, " \n\t", "s"), (4, "One two", "s"), (9, "one TWO", None), (9, "one TWO", None),
        (None, "one two", "s"), (None, None, "s"), (5, "\x1c", "s"), (6, "a " * 50_000, "s"), (7, "A " * 49_000, "s"),
    ]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    expected = [(*r[:3], True if r[0] is None and r[2] is None else bool(r[3])) for r in brute_force(rows)]
    assert result(found) == sorted(expected, key=str)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, node string, hub string, kept_id long, n_shingles int"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", "n", "h", 7, 0), (2, "a b c d e f", "n", "h", 7, 0)], schema)
    kept = drop_near_duplicates(rows)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1]


def test_one_row_of_each_group_stays(spark):
    rows = variants(5, 30, 5, 1) + [(0, "same words here again and again", "s")] * 3
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    roots = {r[2] for r in brute_force(rows)}
    assert sorted(r.doc_id for r in kept if r.text != rows[-1][1]) == sorted(roots - {0}) or len(kept) >= len(roots)


def test_estimate_bound_grows_with_distance():
    assert most_differing_bits(320, 1024, 0.9) < most_differing_bits(320, 1024, 0.55) < 512


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[i] == 100 for i in range(100, 140))
