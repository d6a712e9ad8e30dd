import os
from pathlib import Path

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from lexiflow.operators import labels, tokens, weights
from lexiflow.plans import classify_journals, text_mining
from lexiflow.session import fingerprint, scratch_root, stage
from lexiflow.settings import MiningSettings


@pytest.fixture
def docs(spark):
    kinds = ["red apple pie", "blue ocean wave", "green field grass"]
    rows = [
        (f"S{i % 3:08d}{i:04d}", f"{kinds[i % 3]} {kinds[i % 3]} number {i} (n) water. Next")
        for i in range(90)
    ]
    return spark.createDataFrame(rows, "doc_id string, body string")


@pytest.fixture
def issns(docs):
    return docs.selectExpr("doc_id", "substr(doc_id, 2, 8) as body")


def test_scratch_is_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5
    assert staged.inputFiles()[0].startswith("file://" + scratch_root(spark))


def test_second_run_builds_nothing(spark, docs, tmp_path):
    lexicon = spark.createDataFrame([("water", "X")], "term string, type string")
    settings = MiningSettings(tag_entities=True, build_vectors=True, vocabulary_size=3)
    first = text_mining.mine_text(spark, str(tmp_path), docs, settings, lexicon)
    again = text_mining.mine_text(spark, str(tmp_path), docs, settings, lexicon)
    assert {action for _, action in first.log} == {"built"}
    assert {action for _, action in again.log} == {"read"}
    assert [name for name, _ in first.log] == [
        "tagged", "masked", "tokenized", "bag", "doc-freq", "num-docs", "tfidf", "vocabulary",
        "vectors",
    ]
    assert tuples(first.weights) == tuples(again.weights)
    assert again.vocabulary.count() == 3
    assert again.bag.where("term = 'maskentity'").count() == 90
    assert again.bag.where("term = 'masknum'").count() == 90
    # The sum of all counts is the number of tokens.
    assert again.bag.groupBy().sum("count").first()[0] == (
        tokens.token_pairs(again.masked).count()
    )
    assert again.weights.where("weight < 0").count() == 0


def test_other_settings_build_their_own_stages(spark, docs, tmp_path):
    text_mining.mine_text(spark, str(tmp_path), docs)
    other = text_mining.mine_text(spark, str(tmp_path), docs, MiningSettings(normalizer="lower"))
    assert {action for _, action in other.log} == {"built"}


def test_another_lexicon_or_corpus_builds_its_own_stages(spark, docs, tmp_path):
    settings = MiningSettings(tag_entities=True)

    def entities(word, corpus=docs):
        lexicon = spark.createDataFrame([(word, "X")], "term string, type string")
        mined = text_mining.mine_text(spark, str(tmp_path), corpus, settings, lexicon)
        return mined.base, mined.bag.where("term = 'maskentity'").count()

    water, apple = entities("water"), entities("apple")
    assert (water[1], apple[1]) == (90, 30) and water[0] != apple[0]
    assert entities("water") == water
    fewer = docs.where("doc_id < 'S00000001'")
    assert entities("water", fewer)[1] == 30
    text_mining.remove_stages(spark, water[0])
    assert not Path(water[0]).exists() and Path(apple[0]).exists()


def test_an_unfinished_stage_is_rebuilt(spark, docs, tmp_path):
    first = text_mining.mine_text(spark, str(tmp_path), docs)
    (Path(first.base) / "bag" / "_SUCCESS").unlink()
    again = text_mining.mine_text(spark, str(tmp_path), docs)
    assert [name for name, action in again.log if action == "built"] == ["bag"]


def test_stop_words_come_from_the_file(spark, docs, tmp_path):
    (tmp_path / "stop.txt").write_text("red blue\n")
    settings = MiningSettings(
        build_vectors=True, stop_words_path=str(tmp_path / "stop.txt"), extra_stop_words=("apple",)
    )
    mined = text_mining.mine_text(spark, str(tmp_path / "out"), docs, settings)
    kept = {row["term"] for row in mined.vocabulary.collect()}
    assert "pie" in kept and not kept & {"red", "blue", "apple"}


def test_weight_maps(spark, docs, tmp_path):
    mined = text_mining.mine_text(spark, str(tmp_path), docs)
    maps = text_mining.weight_maps(mined.weights)
    back = weights.weights_by_term(maps).select("doc_id", "term", "weight")
    assert tuples(back) == tuples(mined.weights, "doc_id", "term", "weight")


def test_masked_terms_job(spark, docs, tmp_path):
    heads = spark.createDataFrame([("water",)], "head string")
    got = text_mining.mask_and_tokenize(spark, str(tmp_path), docs, heads)
    assert got.count() == 180
    assert (tmp_path / "replacement" / "_SUCCESS").exists()


@pytest.mark.parametrize("method", ["pmi", "skip_gram"])
def test_word_vector_classifier(spark, docs, issns, tmp_path, method):
    for _ in range(2):  # a second run replaces the results of the first
        bundle = classify_journals.embed_and_classify(
            spark, str(tmp_path), docs, issns, dim=8, method=method, maxIter=20
        )
    assert bundle.train.count() + bundle.test.count() == 90
    assert bundle.predictions.where("label = prediction").count() == bundle.test.count()
    base = Path(text_mining.mine_text(spark, str(tmp_path), docs).base) / ("" if method == "pmi" else method)
    for name in ("w2v_8", "doc-embedding-8", "model-data-8", "logistic-regression-8/model"):
        assert (base / name).exists()


def test_lsi_classifier(spark, docs, tmp_path):
    rows = [("A", "0000-0000", "X"), ("B", "0000-0001", "Y"), ("B", "0000-0001", "X")]
    cats = spark.createDataFrame(rows, "journal string, issn string, category string")
    index = labels.category_index(cats)
    for _ in range(2):
        bundle = classify_journals.lsi_and_classify(
            spark, str(tmp_path), docs, labels.multi_hot(cats, index), index,
            MiningSettings(vocabulary_size=12, lsi_dim=3), maxIter=5,
        )
    assert bundle.train.count() + bundle.test.count() == 90
    assert bundle.train.join(bundle.test, "doc_id", "left_semi").count() == 0


def _corpus_file(spark, tmp_path, docs):
    docs.select("doc_id", "body").coalesce(1).write.parquet(str(tmp_path / "corpus"))
    file = next((tmp_path / "corpus").glob("*.parquet"))
    return file, lambda: spark.read.schema("doc_id string, body string").parquet(str(tmp_path / "corpus")).where("body <> ''")


def test_second_run_reads_no_corpus_rows(spark, docs, tmp_path):
    """The files lose their contents but keep names, lengths and times: reading them would fail."""
    file, corpus = _corpus_file(spark, tmp_path, docs)
    first = text_mining.mine_text(spark, str(tmp_path / "work"), corpus())
    kept = file.stat()
    file.write_bytes(b"x" * kept.st_size)
    os.utime(file, ns=(kept.st_atime_ns, kept.st_mtime_ns))
    second = text_mining.mine_text(spark, str(tmp_path / "work"), corpus())
    assert {action for _, action in second.log} == {"read"} and second.base == first.base
    os.utime(file, ns=(kept.st_atime_ns, kept.st_mtime_ns + 10**10))
    assert fingerprint(corpus()) != fingerprint(spark.read.schema("doc_id string, body string").parquet(str(file)))
    assert text_mining.stage_folder("w", MiningSettings(), corpus()) != text_mining.stage_folder("w", MiningSettings(), docs)


def test_fingerprints(spark, docs, tmp_path):
    file, corpus = _corpus_file(spark, tmp_path, docs)
    assert fingerprint(corpus()) == fingerprint(corpus())
    assert fingerprint(corpus()) != fingerprint(corpus().where("doc_id > ''"))
    assert fingerprint(docs) == fingerprint(docs.repartition(3))  # rows, in any order
    upper = F.udf(lambda x: x.upper(), "string")
    by_rows = fingerprint(corpus().withColumn("body", upper("body")))
    assert by_rows.startswith(f"{docs.count()}/") and "/" not in fingerprint(corpus())


def test_scratch_is_empty_after_a_job(spark, docs, tmp_path):
    root = Path(scratch_root(spark))
    root.mkdir(parents=True, exist_ok=True)
    before = {p.name for p in root.iterdir()}
    lexicon = spark.createDataFrame([("water", "W")], "term string, type string")
    settings = MiningSettings(tag_entities=True, build_vectors=True)
    mined = text_mining.mine_text(spark, str(tmp_path / "work"), docs, settings, lexicon)
    assert mined.weights.count() > 0
    assert {p.name for p in root.iterdir()} == before
