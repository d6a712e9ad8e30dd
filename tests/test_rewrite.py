import re
import tracemalloc

import pyarrow as pa
import pytest
from conftest import tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexiflow.functions import patterns as P
from lexiflow.operators import rewrite, seeds


def bodies(df):
    return [row["body"] for row in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("up 12.5 % here", "up maskpct here"),
        ("p < 0.05", "p masknumexpr "),
        ("5 < p", " masknumexpr p"),
        ("H2O", "H masknum O"),
        ("a (b) c", "a c"),
        ("plain text", "plain text"),
    ],
)
def test_mask_patterns(corpus, text, expected):
    assert bodies(rewrite.mask_patterns(corpus(text))) == [expected]


def test_other_masks_can_be_given(corpus):
    rules = ((P.NUMBER, "#"),)
    assert bodies(rewrite.mask_patterns(corpus("a 1.5 b"), rules)) == ["a# b"]


def test_older_masks_keep_their_quirks(corpus):
    heads = corpus("phenol").selectExpr("body as head")
    masked = seeds.mask_lexicon_and_patterns(corpus("x-2,4-phenols (y) 5 < 6 %"), heads)
    # The name keeps no glued prefix, `5 <` is a plain number, parentheses vanish.
    assert bodies(masked) == ["maskentity  masknum  < maskpct "]
    kept = seeds.mask_lexicon_and_patterns(corpus("a (y) b"), heads, " maskparen ")
    assert bodies(kept) == ["a  maskparen  b"]


def test_no_heads_mask_no_name(corpus):
    heads = corpus("x").selectExpr("body as head").where("false")
    text = "about 12 mice (n=7)"
    assert bodies(seeds.mask_names(corpus(text), heads)) == [text]
    assert bodies(seeds.mask_lexicon_and_patterns(corpus(text), heads)) == ["about masknum  mice "]


def test_names_agree_with_one_pattern_of_all_heads(corpus):
    words = ["phenol", "βcar", "foo", "a", "gamma"]
    heads = corpus(*words).selectExpr("body as head")
    texts = ["(foo)-2-phenol", "2αβcarotene (x foo) 3-", "(R)-gamma 1,2-xfoo", "7) a b [n.b] (n.b", "2-Phenol", "", "1α-γβcarα2b"]
    one = "|".join(re.escape(w) for w in sorted(words))
    pattern = f"{P.LOCANT_HEADER}(?:(?:{one})[a-zA-Z]*){P.LOCANT_TRAILER}"
    wanted = [re.sub(pattern, P.ENTITY_MASK, t) for t in texts]
    got = {r.doc_id: r.body for r in seeds.mask_names(corpus(*texts), heads).collect()}
    assert [got[f"d{i + 1}"] for i in range(len(texts))] == wanted


def test_unglue_heading(corpus):
    df = corpus("AbstractThe cat", "Abstractthe", "AbstractΑlpha", "The Cat")
    assert bodies(rewrite.unglue_heading(df)) == ["The cat", "Abstractthe", "Αlpha", "The Cat"]
    older = rewrite.unglue_heading(corpus("AbstractΑlpha"), P.GLUED_HEADING_ASCII)
    assert bodies(older) == ["AbstractΑlpha"]


def test_filter_masked(corpus):
    masked = rewrite.mask_patterns(corpus("no number", "one 1"))
    assert tuples(rewrite.filter_masked(masked), "doc_id") == [("d2",)]


def test_extract_numerics(corpus):
    got = rewrite.extract_numerics(corpus("- 4 ms and 1.2.3 kg; 3 mg/l"))
    assert tuples(got, "sign", "number", "unit") == [
        ("", "1.2.3", "kg"),
        ("", "3", "mg/l"),
        ("-", "4", "ms"),
    ]


def test_extract_matches_keeps_duplicates(corpus):
    got = rewrite.extract_matches(corpus("aa b aa"), "a+")
    assert tuples(got, "match") == [("aa",), ("aa",)]


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.text(alphabet="ab 01.%<>=+-()\n", max_size=30), min_size=1, max_size=20))
def test_no_digit_survives_masking(corpus, texts):
    for text in bodies(rewrite.mask_patterns(corpus(*texts))):
        assert not re.search("[0-9]", text)


def test_seed_mining(corpus, terms):
    mined = seeds.mine_seeds(corpus("x 2,4-dinitrophenol y", "and 2,4-dinitrophenol."))
    assert tuples(mined) == [("dinitrophenol",)]


def test_clean_seeds(terms):
    mined = terms("water", "phenol", "ab1", "θhenol", name="seed")
    cleaned = seeds.clean_seeds(mined, terms("Water", "Phenol"), terms("phenol"))
    assert tuples(cleaned) == [("phenol",), ("θhenol",)]


def test_seeds_in_dictionary(terms):
    found = seeds.seeds_in_dictionary(terms("water", "phenol", name="seed"), terms("Water"))
    assert tuples(found) == [("water",)]


def test_heads_pattern_and_matches(corpus, terms):
    heads = seeds.seed_heads(terms("dinitrophenol", "dinitrophenyl", name="seed"), 10)
    assert tuples(heads) == [("dinitrophe",)]
    found = seeds.lexicon_matches(corpus("2,4-dinitrophenols and 1-dinitrophenyl-3"), heads)
    assert tuples(found) == [("1-dinitrophenyl-3",), ("2,4-dinitrophenols",)]


@given(
    st.lists(st.text(alphabet="abαβ", min_size=1, max_size=4), min_size=1, max_size=5),
    st.text(alphabet="abZαβγ12(),-= []{}/é.", max_size=40),
)
def test_spans_are_those_of_one_pattern_of_all_heads(heads, text):
    every = "|".join(sorted(heads))
    pattern = re.compile(f"{P.LOCANT_HEADER}(?:(?:{every})[a-zA-Z]*){P.LOCANT_TRAILER}", re.ASCII)
    assert seeds.name_spans(text, set(heads), 4) == [m.span() for m in pattern.finditer(text)]


def test_long_runs_of_marks_cost_one_reading():
    class Heads(set):
        asked = 0

        def __contains__(self, head):
            self.asked += 1
            return super().__contains__(head)

    heads = Heads({"phenol"})
    text = "(" * 20_000 + " 2,4-phenol"
    assert seeds.name_spans(text, heads, 6) == [(0, len(text))]
    assert seeds.name_spans("1" * 20_000 + "-", heads, 6) == []
    assert heads.asked < 7 * 25_000


def test_many_heads_are_met_by_a_join(spark, corpus, terms, monkeypatch):
    texts = ["2,4-phenol and 1-αβγ x", "(α-phenols)-2 3-bc", "phenol 2,4-", "", "[1]benzene 12 αphenol"]
    heads = terms("phenol", "αβ", "b", "benz", "zz", name="head")
    df = corpus(*texts)
    want = bodies(seeds.mask_names(df, heads)), tuples(seeds.lexicon_matches(df, heads))
    monkeypatch.setattr(seeds, "fits_broadcast", lambda table: False)
    masked = seeds.mask_names(df, heads)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert (bodies(masked), tuples(seeds.lexicon_matches(df, heads))) == want
    assert "regexp_replace" not in plan and want[0][0].startswith(P.ENTITY_MASK)


def test_one_text_of_a_batch_stands_in_memory_at_a_time():
    bodies = pa.array(["x" * 20_000] * 2_000)
    tracemalloc.start()
    longest = max(len(body) for body, own in seeds._rows(bodies, pa.nulls(2_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert longest == 20_000 and peak < 1_000_000
