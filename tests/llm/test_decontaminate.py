import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiflow.llm.decontaminate import Index, benchmark_hits, decontaminate, edit_distance, fold
from lexiflow.llm.words import words

DOCS = "doc_id long, text string, item_id string, edits string"
ITEMS = "item_id long, text string, doc_id int"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == plain_distance(a, b)


def tokens(text):
    return words([fold(text.encode())])[1].tolist()


def brute_force(docs, items):
    out = set()
    for doc_id, text, *_ in docs:
        doc = tokens(text or "")
        for item_id, item, *_ in items:
            item = tokens(item or "")
            starts = range(max(1, len(doc) - len(item) + 1)) if item and doc else ()
            found = min(((plain_distance(item, doc[s : s + len(item)]), s) for s in starts), default=(1e9, 0))
            if item and found[0] <= int(0.2 * len(item)):
                out.add((doc_id, item_id, found[0], found[1], len(item)))
    return out


def edited(draw, words_in, most):
    out = list(words_in)
    for _ in range(most):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [f"new{draw.randrange(999)}"]
    return out


def test_edited_passages_are_found(spark):
    draw = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(3, 90))), 0) for i in range(40)]
    docs = []
    for i in range(160):
        text = draw.choices(vocabulary, k=draw.randint(0, 60))
        if i % 2:
            item = draw.choice(items)[1].split()
            text += edited(draw, item, draw.randint(0, int(0.2 * len(item)))) + draw.choices(vocabulary, k=draw.randint(0, 60))
        docs.append((i, " ".join(text).title() + ".", "", ""))
    got = {tuple(r) for r in benchmark_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    wanted = brute_force(docs, items)
    assert len({x[:2] for x in got} & {x[:2] for x in wanted}) >= 0.97 * len(wanted)
    assert {x[:3] for x in got if x[:2] in {y[:2] for y in wanted}} <= {x[:3] for x in wanted}
    assert {x[:2] for x in got} <= {x[:2] for x in wanted}


def test_blocks_of_the_benchmark_give_the_same(spark):
    items = spark.createDataFrame([(i, f"item {i} has some words of its own {i * i}", 0) for i in range(30)], ITEMS)
    docs = spark.createDataFrame([(i, f"Before. Item {i}, has some words of its own {i * i}! After", "", "") for i in range(60)], DOCS)
    whole = sorted(map(tuple, benchmark_hits(docs, items).collect()))
    assert whole == sorted(map(tuple, benchmark_hits(docs, items, block_bytes=200).collect())) and len(whole) >= 30
    assert sorted(r.doc_id for r in decontaminate(docs, items, block_bytes=200).collect()) == list(range(30, 60))


def test_odd_rows(spark):
    items = [(1, None, 0), (2, "", 0), (3, "?!", 0), (None, "alpha beta gamma delta epsilon", 0), (5, "word", 0), (5, "word", 0)]
    docs = [(1, None, "", ""), (2, "", "", ""), (3, "...", "", ""), (None, "alpha beta gamma delta epsilon", "", ""),
            (4, "x " * 60_000 + "Alpha, beta gamma delta epsilon", "", ""), (4, "some word", "", ""), (4, "some word", "", "")]
    frame = spark.createDataFrame(docs, DOCS)
    got = {tuple(r) for r in benchmark_hits(frame, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(None, None, 0, 0, 5), (4, None, 0, 60_000, 5), (4, 5, 0, 1, 1)}
    left = decontaminate(frame, spark.createDataFrame(items, ITEMS))
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert benchmark_hits(frame, spark.createDataFrame([], ITEMS)).count() == 0
    assert benchmark_hits(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_target_recall_at_the_largest_distance():
    draw = random.Random(9)
    found = tried = 0
    for n in (10, 25, 50, 80):
        for _ in range(40):
            item = [f"v{draw.randrange(2000)}" for _ in range(n)]
            text = [f"v{draw.randrange(2000)}" for _ in range(100)] + edited(draw, item, n // 5) + ["end"] * 100
            if brute_force([(1, " ".join(text))], [(1, " ".join(item))]):
                tried += 1
                index = Index([(1, " ".join(item).encode())])
                found += bool(next(index.search([" ".join(text).encode()])))
    assert tried > 60 and found >= 0.95 * tried


def test_recall_by_length_with_clumped_and_spread_edits():
    draw = random.Random(5)
    for n in (5, 7, 10, 16, 24, 31, 48, 72, 100):
        for clumped in (True, False):
            items, texts, most = [], [], n // 5
            for trial in range(100):
                item = [f"v{draw.randrange(2000)}" for _ in range(n)]
                passage, at = list(item), draw.randint(0, n - most)
                if clumped:
                    passage[at : at + most] = [f"new{draw.randrange(999)}" for _ in range(most)]
                else:
                    for at in draw.sample(range(n), most):
                        passage[at] = f"v{draw.randrange(2000)}"
                before = [f"start{draw.randrange(2000)}" for _ in range(draw.randint(0, 50))]
                items.append((trial, " ".join(item).encode()))
                texts.append(" ".join([*before, *passage, *["end"] * 50]).encode())
            hits = list(Index(items).search(texts))
            assert sum(any(h[0] == i and h[1] <= most for h in found) for i, found in enumerate(hits)) >= 95, (n, clumped)


def test_few_words_that_repeat():
    draw = random.Random(6)
    items = [(i, " ".join(f"v{draw.randrange(9)}" for _ in range(draw.randint(1, 16)))) for i in range(12)]
    docs = []
    for i in range(60):
        item = draw.choice(items)[1].split()
        text = [f"v{draw.randrange(9)}" for _ in range(draw.randint(0, 9))] + edited(draw, item, len(item) // 5)
        docs.append((i, " ".join(text + [f"v{draw.randrange(9)}" for _ in range(draw.randint(0, 9))])))
    index = Index([(i, text.encode()) for i, text in items])
    found = index.search([text.encode() for _, text in docs])
    got = {(i, hit[0]) for (i, _), hits in zip(docs, found) for hit in hits}
    wanted = {x[:2] for x in brute_force(docs, items)}
    assert got <= wanted and len(got) >= 0.97 * len(wanted)


def test_the_index_grows_with_the_words_of_the_items():
    draw = random.Random(7)

    def cells(count):
        index = Index([(i, " ".join(f"w{draw.randrange(50_000)}" for _ in range(40)).encode()) for i in range(count)])
        return len(index.member) + sum(len(keys) for _, _, tables, _ in index.classes.values() for keys, _, _ in tables)

    assert cells(400) < 4.2 * cells(100)


def test_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame([(1, "some word", 7, "b"), (2, "another", 8, "c")], "doc_id long, text string, body long, body_ string")
    items = spark.createDataFrame([(5, "word", 0)], ITEMS)
    assert decontaminate(docs, items).collect() == [(2, "another", 8, "c")] and decontaminate(docs, items).columns == docs.columns
