import math

import pyarrow as pa
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.functions.stem import stem
from lexiflow.operators import annotate, tokens, weights


def test_sentences_keep_punctuation(corpus):
    df = corpus("Mr. Cat sat. Why?\n...no", " \n ")
    got = tokens.tokenize_sentences(df).select(F.concat_ws(" ", "terms"))
    assert tuples(got) == [(". . .",), ("Cat sat .",), ("Mr .",), ("Why ?",), ("no",)]


def test_sentences_lose_no_token(corpus):
    df = corpus("a.b! c\n\n.d ?e")
    whole = tokens.tokens_per_doc(df).first()["tokens"]
    parts = tokens.sentence_terms(df).select(F.explode("terms").alias("t"))
    assert sorted(whole) == sorted(row["t"] for row in parts.collect())


def test_normalisers(corpus):
    df = corpus("The CATS")
    for mode, expected in {
        "none": ["The", "CATS"],
        "lower": ["the", "cats"],
        "stem": ["The", "CATS"],
        "lower_stem": ["the", "cat"],
    }.items():
        assert tokens.tokenize_sentences(df, mode).first()["terms"] == expected
    own = tokens.tokenize_sentences(df, lambda a: F.transform(a, F.upper))
    assert own.first()["terms"] == ["THE", "CATS"]


# Pairs published with the stemming algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "radicalli": "radic", "vileli": "vile", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "yes": "ye", "by": "by", "yearly": "yearli",
}


def test_stems(terms):
    got = terms(*STEMS).select("term", stem(F.col("term")).alias("s"))
    assert {row["term"]: row["s"] for row in got.collect()} == STEMS


def test_pattern_counts(corpus, terms):
    df = corpus("The cat, éabc x1y cats", "42", "the The")
    plain = tokens.pattern_term_counts(df, stemmed=False)
    assert tuples(plain.where("doc_id = 'd1'"), "term", "count") == [
        ("cat", 1),
        ("cats", 1),
        ("the", 1),
    ]
    assert tuples(plain.where("doc_id = 'd2'"), "term", "count") == [(None, 0)]
    stemmed = tokens.pattern_term_counts(df, terms("the"))
    assert sorted(map(tuple, stemmed.collect()), key=str) == [
        ("d1", "cat", 2),
        ("d2", None, 0),
        ("d3", None, 0),
    ]


def test_treebank_tokens(corpus):
    df = corpus("can't stop... it's")
    got = [row["token"] for row in tokens.ptb_tokens(df).collect()]
    assert got == ["ca", "n't", "stop", ".", ".", ".", "it", "'s"]
    line = "Cannot (really) say -- \"we'll go.\""
    got = [row["token"] for row in tokens.ptb_tokens(corpus(line)).collect()]
    assert got == [
        "Can", "not", "(", "really", ")", "say", "--", '"', "we", "'ll", "go", ".", '"',
    ]


@pytest.mark.parametrize(
    "token, shape",
    [
        ("Cat", "cat"), ("7", "7"), ("42", "0"), ("4th", "NUM"), ("x2", "NUMX"),
        ("a-b", "CPLX"), ("é", "CPLX"), ("AbstractThe", "the"), (".", "."), ("...", "CPLX"),
    ],
)
def test_token_shape(terms, token, shape):
    assert tokens.token_shapes(terms(token, name="token")).first()["shape"] == shape


def test_annotation(spark, corpus):
    lexicon = spark.createDataFrame(
        [("<", "NN", "<"), ("the", "DT", "the"), ("are", "VBP", "be")],
        "term string, penn_tag string, lemma string",
    )
    got = annotate.annotate_tokens(corpus("< The Cats are", ""), lexicon)
    assert tuples(got) == [
        ("d1", "<//<|//<|noun|0|0> <The|the|other|0|0> <Cats|cats|other|0|0> <are|be|verb|0|0>"),
        ("d2", ""),
    ]
    lines = annotate.annotation_lines(got.where("doc_id = 'd2'"))
    assert tuples(lines) == [("d2\t1\t",)]


def test_a_large_lexicon_stays_a_table(spark, corpus, monkeypatch):
    rows = [("the", "DT", "the"), ("cats", "NNS", "cat"), ("cats", "VBZ", "cat"), (">", "NN", None), (None, "NN", "x")]
    lexicon = spark.createDataFrame(rows, "term string, penn_tag string, lemma string")
    df = corpus("The CATS > cats", "the | dog", None, "", ids=["a", "a", "b", "c"])
    one = annotate.annotate_tokens(df, lexicon)
    want = tuples(one)
    assert ("a", "<The|the|other|0|0> <CATS|cat|noun|0|0> <//>|//>|noun|0|0> <cats|cat|noun|0|0>") in want
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(annotate, "fits_broadcast", lambda table: False)
    two = annotate.annotate_tokens(df, lexicon)
    assert tuples(two) == want and ("b", "") in want and ("c", "") in want
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan


def test_annotated_articles_join_on_id(spark, corpus):
    lexicon = spark.createDataFrame([], "term string, penn_tag string, lemma string")
    got = annotate.annotate_articles(
        corpus("T", "U"), corpus("a"), corpus("1234-5678", "x"), lexicon
    )
    assert tuples(got) == [("d1", "1234-5678", "<T|t|other|0|0>", "<a|a|other|0|0>")]


def test_unknown_words(corpus, terms):
    got = tokens.oov_counts(corpus("Cat dog DOg Dog a"), terms("cat"))
    assert [tuple(row) for row in got.collect()] == [("dog", 2), ("og", 1)]


def test_token_frequencies(corpus):
    got = tokens.token_freq_per_doc(corpus("a bb a cccc"), longer_than=1)
    assert tuples(got, "token", "count") == [("bb", 1), ("cccc", 1)]
    maps = tokens.counts_as_map(tokens.token_freq_per_doc(corpus("a b a")), "token")
    assert maps.first()["counts"] == {"a": 2, "b": 1}


def test_bag_over_several_rows(spark):
    rows = spark.createDataFrame(
        [("d1", ["a", "b"]), ("d1", ["a"]), ("d2", [])], "doc_id string, terms array<string>"
    )
    bag = weights.bow_per_doc(rows)
    assert tuples(bag) == [("d1", "a", 2), ("d1", "b", 1)]
    assert tuples(weights.doc_count(bag)) == [(1,)]


def test_tfidf(spark):
    import math

    bag = spark.createDataFrame(
        [("d1", "a", 2), ("d1", "b", 1), ("d2", "a", 1)], "doc_id string, term string, count long"
    )
    got = {(r["doc_id"], r["term"]): r["weight"] for r in weights.tfidf(bag).collect()}
    assert got == pytest.approx(
        {("d1", "a"): 0.0, ("d2", "a"): 0.0, ("d1", "b"): math.log(2) / 3}
    )


def test_empty_documents_count_in_n(spark):
    bag = spark.createDataFrame(
        [("d1", "a", 1), ("d2", None, 0)], "doc_id string, term string, count long"
    )
    assert weights.tfidf(bag).first()["weight"] == pytest.approx(0.6931, abs=1e-4)


def test_weights_from_maps(spark):
    maps = spark.createDataFrame([("d1", {"a": 0.5})], "doc_id string, weights map<string,double>")
    assert tuples(weights.weights_by_term(maps)) == [("a", "d1", 0.5)]


def test_samples(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("doc_id"))
    share = weights.sample_by_hash(ids, 0.3).count() / 2000
    assert 0.25 < share < 0.35
    assert 0.2 < weights.sample_rows(ids, 0.3).count() / 2000 < 0.4


def test_letter_terms_are_whole_words(corpus):
    df = corpus("abc_d abc éabc abcé abc1 ABCDE ab")
    assert df.select(X.letter_terms(F.col("body"), 3)).first()[0] == ["abc", "abcde"]


def test_stop_words_with_several_rows_of_one_id(corpus, terms):
    df = corpus("cat cat", "dog the", "the", "", ids=["d1", "d1", "d2", "d3"])
    got = tokens.pattern_term_counts(df, terms("the"), stemmed=False)
    assert tuples(got) == [("d1", "cat", 2), ("d1", "dog", 1), ("d2", None, 0), ("d3", None, 0)]


def test_stop_words_cost_no_second_reading(corpus, terms):
    df = corpus("cat cat the")
    plan = tokens.pattern_term_counts(df, terms("the"), stemmed=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_sentences_stemmed_by_vocabulary(corpus):
    df = corpus("The cats ran. CATS running!", "ponies")
    got = tokens.tokenize_sentences(df, "lower_stem")
    assert tuples(got) == [("d1", ["cat", "run", "!"]), ("d1", ["the", "cat", "ran", "."]), ("d2", ["poni"])]


def test_annotated_by_columns_as_text_by_text(monkeypatch):
    rows = [["The", "<", "cat"], None, [], ["|", ">"], ["Cat", "<>", "//<", "é"] * 3, ["a"]]
    lowered = [row and [word.lower() for word in row] for row in rows]
    known = {"cat": "|cat|noun|0|0>", "<": "|//<|noun|0|0>", "a": "|a|other|0|0>"}
    terms, entries = pa.array(list(known)), pa.array(list(known.values()))
    of_lists = pa.list_(pa.string())
    for at_once in (1, 5, 1000):
        monkeypatch.setattr(annotate, "TOKENS_AT_ONCE", at_once)
        for a, b in ((0, 6), (1, 5), (2, 2)):
            got = annotate.annotated_texts(pa.array(rows, of_lists)[a:b], pa.array(lowered, of_lists)[a:b], terms, entries)
            assert got.to_pylist() == [annotate.annotated_text(t or [], w or [], known) for t, w in zip(rows[a:b], lowered[a:b])]


def test_a_lexicon_of_half_a_million_words_goes_to_the_texts(spark, corpus, monkeypatch):
    """The texts then keep their place: no row is made for a word of a document."""
    monkeypatch.setattr(annotate, "lookup_join", None)
    words = spark.range(600_000).selectExpr("concat('w', id) as term", "'NN' as penn_tag", "'w' as lemma")
    got = annotate.annotate_tokens(corpus("W599999 x"), words)
    assert tuples(got) == [("d1", "<W599999|w|noun|0|0> <x|x|other|0|0>")]


def test_tfidf_of_a_vocabulary_and_stored_totals(spark):
    """Left-out terms count in the totals; a bag with totals is weighted without an exchange."""
    bag = spark.createDataFrame(
        [("d1", "a", 1), ("d1", "b", 3), ("d2", "a", 2), ("d3", "c", 1), ("d4", None, 0), (None, "a", 1)],
        "doc_id string, term string, count long",
    )
    freqs = spark.createDataFrame([("b", 1), ("c", 1)], "term string, df long")
    expected = [("d1", "b", pytest.approx(0.75 * math.log(5))), ("d3", "c", pytest.approx(math.log(5)))]
    totals = weights.with_totals(bag)
    assert tuples(weights.tfidf(bag, freqs)) == expected
    found = weights.tfidf(totals, freqs, spark.createDataFrame([(5,)], "num_docs long"))
    assert tuples(found) == expected
    weighted = weights.tfidf(totals.localCheckpoint(), freqs, spark.createDataFrame([(5,)], "num_docs long"))
    assert "Exchange hashpartitioning" not in weighted._jdf.queryExecution().executedPlan().toString()
