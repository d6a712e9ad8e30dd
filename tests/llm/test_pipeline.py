import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute_force as benchmark_pairs
from test_line_dedup import brute_force as cleaned_lines
from test_near_dedup import brute_force as groups

import __spark_entry__ as entry_points
import corpus_pipeline
from lexiflow.llm.mixing import mix
from lexiflow.llm.vocabulary import PIECES
from lexiflow.session import stage

SMALL = Path("/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
needs_pieces = pytest.mark.skipif(not Path(PIECES).exists(), reason="no public vocabulary")

CONTRACTS = {
    "op1_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op4_scoring": {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
        "train_tokens": "bigint", "base_score": "double", "score": "double",
    },
    "op5_pseudonyms": {"doc_id": "bigint", "text": "string"},
    "op6_line_dedup": {"doc_id": "bigint", "text": "string"},
    "op7_archive": {
        "page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint",
    },
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def corpus(spark, folder):
    draw = random.Random(6)
    en, de = ["the", "ing", "tion", "er", "and"], ["sch", "ung", "der", "ein", "keit"]
    words = lambda parts, n: " ".join("".join(draw.choices(parts, k=draw.randint(1, 5))) for _ in range(n))
    items = [(i, words(en, 25)) for i in range(5)]
    rows = []
    for i in range(150):
        lang, parts = ("en", en) if i % 3 else ("de", de)
        lines = [words(parts, 20) for _ in range(4)]
        if i % 4 == 0:
            lines.insert(2, "Accept all of our cookies now")
        if i % 10 == 0:
            lines[1] += " " + draw.choice(items)[1]
        rows.append([i, "\n".join(lines), lang, f"s{i % 9}", 0])
        if i % 7 == 0:
            rows.append([1000 + i, rows[-1][1] + " end", lang, f"s{(i + 1) % 9}", 0])
    rows += [[2000, None, "en", "s1", 0], [2001, "12 34", "en", None, 0], [2002, "Accept all of our cookies now", "en", "s2", 0], [2003, "", None, None, None]]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


@needs_pieces
def test_each_stage_against_a_plain_version(spark, tmp_path):
    items = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mix"]
    for name, apply in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        columns = docs.columns
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        if name != "mix":
            assert docs.columns == columns and len(after) == len(rows)
        if name == "language":
            lettered = {i for i, t, _ in before if any(c.isalpha() for c in t or "")}
            assert set(after) == lettered
        if name == "lines":
            cleaned = {i: (n, t) for i, _, n, t in cleaned_lines(before, 6)}
            assert {i: t for i, (n, t) in cleaned.items() if t.strip() or not n} == {i: r.text for i, r in after.items()}
            assert any(n for n, _ in cleaned.values()) and 2002 not in after
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            assert set(after) == {i for i, _, _, kept in groups(before) if kept} and len(rows) < len(before)
        if name == "benchmark":
            dirty = {x[0] for x in benchmark_pairs(before, items)}
            assert set(after) == {i for i, *_ in before} - dirty and dirty
        if name == "mix":
            assert docs.columns == [*columns, "copy"] and set(after) <= {i for i, *_ in before}
            assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and max(r.copy for r in rows) <= 3


CLASHING = (
    "id", "site", "words", "copies", "copy", "n", "place", "doc", "row", "drop", "drop_row", "_row", "at", "line", "high", "low",
    "n_lines", "n_removed", "body", "_body", "lang_pred", "score", "size", "draw", "target", "item_id", "edits", "component_id", "kept",
)


@needs_pieces
def test_columns_of_the_user_go_through_every_stage(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = stage(docs.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHING]), "clashing")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        assert docs.columns == ([*columns, "copy_"] if name == "mix" else columns), name
    rows = docs.collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "c d", "en", None, 3), (None, "c e", "en", None, 3), (2, "f", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    wanted = mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    got = corpus_pipeline.mix_stage(spark, docs, "").groupBy("doc_id").count().collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in wanted)))


@needs_pieces
def test_run_is_the_stages_in_order(spark, tmp_path):
    corpus(spark, str(tmp_path))
    one, two = (sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and one


@needs_pieces
def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_of_the_queries(spark, name):
    if name == "op8_language" and not Path(PIECES).exists():
        pytest.skip("no public vocabulary")
    types = dict(entry_points.queries()[name](spark, str(SMALL)).dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_mixing", "op6_line_dedup", "op7_archive", "op9_top_k"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    frame = entry_points.queries()[name](spark, str(SMALL))
    result = db.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    columns = sorted(frame.columns)
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == wanted
