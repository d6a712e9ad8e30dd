import math
import random

import pytest
from conftest import tuples

from lexiflow.operators import search


@pytest.fixture
def documents(spark):
    rows = [
        ("S1", "The red fox", "1111-1111", "Fox News", "red red dog"),
        ("S2", "A blue dog and the red dog", "2222-2222", "Dog", "a"),
        ("S3", None, None, "", "blue"),
        ("", "red", "x", "x", "x"),
    ]
    names = "doc_id string, title string, issn string, journal string, abstract string"
    return search.index_documents(spark.createDataFrame(rows, names))


def test_postings(documents):
    got = search.build_postings(documents).where("doc_id = 'S2' and field in ('title', 'issn')")
    rows = {r["term"]: (r["freq"], r["positions"], [tuple(o) for o in r["offsets"]], r["doc_len"])
            for r in got.collect()}
    assert rows == {
        "blue": (1, [1], [(2, 6)], 4),
        "dog": (2, [2, 6], [(7, 10), (23, 26)], 4),
        "red": (1, [5], [(19, 22)], 4),
        "2222-2222": (1, [], [], 1),
    }


def test_words_of_a_text_are_not_exchanged(documents):
    """Neither sorted by a window nor moved as rows of single words."""
    plan = search.build_postings(documents.repartition(3, "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 2  # documents once for the words, once for the issn


def test_postings_of_texts_that_share_an_id(spark, monkeypatch):
    """Places go by the words of all texts; batches of any size give the same."""
    rows = [("S1", "A red fox, red", "1", "j", "b"), ("S1", "A red fox, red", "1", "j", None), ("S2", "Red. Élan", "1", "", "c c")]
    names = "doc_id string, title string, issn string, journal string, abstract string"
    documents = search.index_documents(spark.createDataFrame(rows, names))

    def found():
        got = search.build_postings(documents).where("field = 'title'").collect()
        return {(r.doc_id, r.term): (r.freq, r.positions, [tuple(o) for o in r.offsets], r.doc_len) for r in got}

    whole = found()
    assert whole["S2", "élan"] == (1, [1], [(5, 9)], 2)
    assert whole["S1", "fox"] == (2, [2, 2], [(11, 14), (15, 18)], 6)
    monkeypatch.setattr(search, "WORDS_AT_ONCE", 1)
    assert found() == whole


def test_lookup(documents):
    assert tuples(search.index_size(documents)) == [(3,)]
    assert tuples(search.lookup_id(documents, "s2"), "doc_id") == [("S2",)]
    assert search.lookup_id(documents, "zz").count() == 0


def bm25(n, df, freq, length, mean):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * freq * 2.2 / (
        freq + 1.2 * (0.25 + 0.75 * length / mean)
    )


def test_scores(documents, tmp_path):
    index = search.save_index(documents, str(tmp_path / "index"))
    got = search.search(index, "title", "Red the DOG", 5).collect()
    red = [bm25(2, 2, 1, length, 3) for length in (2, 4)]
    dog = bm25(2, 1, 2, 4, 3)
    assert [r["doc_id"] for r in got] == ["S2", "S1"]
    assert [r["score"] for r in got] == pytest.approx([red[1] + dog, red[0]], abs=1e-6)
    assert [tuple(r)[2:] for r in got] == [
        ("A blue dog and the red dog", "2222-2222", "Dog", "a", 2),
        ("The red fox", "1111-1111", "Fox News", "red red dog", 2),
    ]
    assert search.search(index, "title", "red", 1).first().total == 2
    assert search.search(index, "title", "unseen", 5).count() == 0
    assert search.search(search.load_index(index.postings.sparkSession, str(tmp_path / "index")), "title", "red", 1).count() == 1


def test_terms_are_a_filter_of_one_scan(spark, documents, tmp_path, monkeypatch):
    index = search.save_index(documents, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "red dog")], "query_id long, text string")
    plan = search.score(index, queries, "title")._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan parquet")[1:] if "positions" in part or "doc_len" in part]
    assert len(scans) == 1 and "In(term, [dog,red])" in scans[0].replace("red,dog", "dog,red")
    best = tuples(search.search_batch(index, queries, "title", 5))
    monkeypatch.setattr(search, "TERMS_IN_FILTER", 1)
    assert tuples(search.search_batch(index, queries, "title", 5)) == best


def test_batch_and_hits(spark, documents, tmp_path):
    postings = search.save_index(documents, str(tmp_path / "index"))
    queries = spark.createDataFrame(
        [(1, "red"), (2, "blue red"), (3, "none")], "query_id long, text string"
    )
    hits = tuples(search.search_hits(postings, queries, "title"))
    assert hits == [(1, 2), (2, 2), (3, 0)]
    best = search.search_batch(postings, queries, "title", 1)
    assert tuples(best, "query_id", "rank", "doc_id") == [(1, 1, "S1"), (2, 1, "S2")]


def test_equal_scores_go_by_id(spark, tmp_path):
    rows = [(f"S{i}", "same text", "1", "j", "b") for i in (3, 1, 2)]
    names = "doc_id string, title string, issn string, journal string, abstract string"
    documents = search.index_documents(spark.createDataFrame(rows, names))
    index = search.save_index(documents, str(tmp_path / "index"))
    got = search.search(index, "title", "text", 2).collect()
    assert [r["doc_id"] for r in got] == ["S1", "S2"]


def test_ranges_are_ruled_out_by_the_nth_score(spark, tmp_path):
    """Fewer postings are scored than match, and the best are those of all scores."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"S{i:04}", " ".join(draw.choices(words, range(60, 0, -1), k=draw.randint(3, 30))), "1", "j", "b") for i in range(1500)]
    rows += [(f"T{i}", "w58 w59 w57", "1", "j", "b") for i in range(4)]
    names = "doc_id string, title string, issn string, journal string, abstract string"
    index = search.save_index(search.index_documents(spark.createDataFrame(rows, names)), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "w57 w58 w59"), (2, "w0 w59 w59"), (3, "w30"), (4, "unseen")], "query_id long, text string")
    found = search.bounded_search(index, queries, "title", 3)
    scored = sorted(search.score(index, queries, "title").collect(), key=lambda r: (r.query_id, -r.score, r.doc_id))
    wanted = [(q, n, r.doc_id, r.score) for q in (1, 2, 3) for n, r in enumerate([r for r in scored if r.query_id == q][:3], 1)]
    assert tuples(found.best) == wanted
    postings = index.postings.where("field = 'title'").select("term", "range")
    matched = postings.join(found.cells, ["term", "range"]).count()
    read = postings.join(found.read, ["term", "range"]).count()
    assert 0 < read < matched / 2
    assert found.read.distinct().count() == found.read.count()
    hits = dict(tuples(search.search_hits(index, queries, "title")))
    assert hits == {q: len([r for r in scored if r.query_id == q]) for q in (1, 2, 3, 4)}


def test_unknown_field(spark, documents, tmp_path):
    index = search.save_index(documents, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "red")], "query_id long, text string")
    assert search.search_batch(index, queries, "none", 3).count() == 0
    assert tuples(search.search_hits(index, queries, "none")) == [(1, 0)]
