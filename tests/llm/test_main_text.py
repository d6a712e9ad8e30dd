import time

import numpy as np

from lexiflow.llm.main_text import _above, _main_parts, extract, main_text, parse, site_templates, subtrees

SCHEMA = "page_id long, url string, html string, text string, host int"
NONE = np.zeros(0, np.int64)


def test_article_and_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body><header>top</header><nav><ul><li><a href="/a">menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad x">buy</div>
    <article><h1>Title &amp; more</h1><p><b>First<br>line<p>Second &lt;b&gt; a&nbsp; b
    <ul><li>one<li>two</ul><aside>side</aside><form><p>type</p></form><div id="comments"><p>me too</p></div>
    <table><tr><td>c1<td>c2<tr><td>c3</table></article><div class="cookie-notice">ok?</div><footer>&copy; x</footer>"""
    assert main_text(page, NONE) == "Title & more\nFirst line\nSecond <b> a b\none\ntwo\nc1\nc2\nc3"


def test_main_element_then_body():
    assert main_text("<div class=sidebar>s</div><main><p>a</main><p>b", NONE) == "a"
    assert main_text("<div role='main'><header><h2>h</h2></header>x</div>y", NONE) == "h\nx"
    assert main_text("<h1>a</h1>b<div>c</div>d<nav>e</nav>", NONE) == "a\nb\nc\nd"


def test_broken_markup():
    assert main_text("<p>a <b>b</i> c</p></div></p>d", NONE) == "a b c\nd"
    assert main_text("a < b and 3<4 <p title='x>y'>ok</p><p title=\"open>z", NONE) == "a < b and 3<4\nok\nz"
    assert main_text("text<script>never ends", NONE) == "text"
    assert main_text("text<!-- never ends <p>x", NONE) == "text"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000, NONE) == "deep"
    assert main_text("", NONE) == "" and main_text("&#65;&eacute;&bogus;", NONE) == "Aé&bogus;"


def test_deep_pages_take_linear_time():
    deep = "<div>" * 8000 + "<article>x</article>" + "</div>" * 8000
    stray = "<div>" * 8000 + "</b></span></section>" * 8000
    items = "<ul>" * 4000 + "<li>a" * 4000
    begin = time.process_time()
    assert subtrees(deep)[1] == set() and main_text(deep, NONE) == "x"
    assert len(subtrees(stray)[1]) == 8000 and main_text(stray, NONE) == ""
    assert main_text(items, NONE).count("a") == 4000
    assert time.process_time() - begin < 5


def test_elements_around_the_main_parts():
    root = parse("<body><div id=o><div id=i><article>a</article></div><p>b</p></div><div id=l><b>c</b></div><article><div>d</div></article>")
    parts = {id(p) for p in _main_parts(root)}

    def holds(element):
        inner = [c for c in element.children if not isinstance(c, str) and id(c) not in parts]
        below = set().union(*map(holds, inner))
        return below | {id(element)} if below or parts & {id(c) for c in element.children} else below

    assert len(parts) == 2 and _above(root, parts) == holds(root)


def site(n, host, extra=""):
    """Pages without an article: own paragraphs inside a common frame."""
    frame = "<div><span>Welcome to %s</span><em>Slogan</em></div>" % host
    return [(i, f"http://{host}/{i}", f"<body>{frame}<p>Own text {i} {extra}</p><p>Second {i}</p></body>", "t", 0) for i in range(n)]


def test_templates_go_where_they_recur(spark):
    rows = site(30, "a.example") + site(3, "b.example")
    got = {(r.url, r.text) for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ("http://a.example/7", "Own text 7\nSecond 7") in got
    assert ("http://b.example/1", "Welcome to b.exampleSlogan\nOwn text 1\nSecond 1") in got


def test_few_and_many_templates_give_the_same(spark):
    frame = spark.createDataFrame(site(30, "a.example") + site(12, "b.example") + [(None, None, None, None, None)], SCHEMA)
    few = sorted(map(str, extract(frame).collect()))
    assert few == sorted(map(str, extract(frame, most_broadcast=0).collect()))


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://c.example/x", "<body><p>The one article</p></body>", "t", 0) for i in range(50)]
    articles = [(i, f"http://d.example/{i}", f"<article><p>Shared words</p><p>{i}</p></article>", "t", 0) for i in range(50)]
    frame = spark.createDataFrame(rows + articles, SCHEMA)
    assert site_templates(frame).count() == 0
    texts = {r.text for r in extract(frame).collect()}
    assert "The one article" in texts and "Shared words\n7" in texts


def test_odd_rows(spark):
    rows = [(1, None, "<p>a", "t", 0), (2, "not a url", "", "t", 0), (None, "http://h", None, "t", 0), (3, "//H:80/x", "é" * 200_000, "t", 0), (1, None, "<p>a", "t", 0)]
    got = sorted(map(str, extract(spark.createDataFrame(rows, SCHEMA)).select("page_id", "n_chars", "text").collect()))
    assert len(got) == 5 and got[0] == got[1] == "Row(page_id=1, n_chars=1, text='a')" and "n_chars=200000" in got[3]
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_inside_the_main_part(spark):
    box = "<div class='x9'><b>Read on</b><ul><li>First<li>Second</ul></div>"
    common = f"<h2>Summary</h2><p>Shared words</p>{box}<section><p>Own {{0}}</p></section><table><tr><td>Call us</table>"
    pages = [f"<article>{common}</article>", f"<main>{common}</main>"]
    rows = [(i, f"http://{h}.example/{i}", pages[h == "m"].format(i), "t", 0) for h, n in (("a", 20), ("m", 20), ("few", 5)) for i in range(n)]
    for most in (1_000_000, 0):
        got = {(r.url, r.text) for r in extract(spark.createDataFrame(rows, SCHEMA), most_broadcast=most).collect()}
        for host in "am":
            assert (f"http://{host}.example/3", "Summary\nShared words\nOwn 3") in got
        assert ("http://few.example/3", "Summary\nShared words\nRead on\nFirst\nSecond\nOwn 3\nCall us") in got
