from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from lexiflow.catalog.oracle import build
from lexiflow.catalog.queries import QUERIES

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")

# One query of each family; tools/check_oracle.py compares all of them.
CHECKED = [
    "scan_id_text", "xml_fields", "mask_lexicon", "extract_numerics", "clean_seeds",
    "tag_entities", "terms_stem", "pattern_term_counts", "ptb_tokens", "annotate_tokens",
    "tfidf_top_terms", "doc_vectors_mean", "label_all", "search_batch",
]


def test_names_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) - set(build()) == {
        "word2vec", "lsi_singular_values", "lsi_doc_vectors", "lsi_term_vectors",
        "predict_labels", "classify_by_word_vectors", "classify_by_lsi",
    }


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["doc_id", "term", "weight", "rank"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, db, name):
    frame = entry_points.queries()[name](spark, str(SMALL))
    result = db.execute(entry_points.oracle_sql()[name])
    columns = sorted(frame.columns)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    got = [tuple(row) for row in frame.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
