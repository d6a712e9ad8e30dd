from conftest import tuples
from pyspark.sql import functions as F

from lexiflow.operators import search
from lexiflow.sources import sinks, tables, xml

ARTICLE = """<a xmlns:{p}="http://purl.org/dc/elements/1.1/"
 xmlns:x="http://www.elsevier.com/xml/xocs/dtd" xmlns="http://any/where">
 <core><pii>S0001-(12)X</pii><pii>other</pii><{p}:title>A &amp; <i>B</i></{p}:title>
 <{p}:creator>One</{p}:creator><deep><{p}:creator>Two</{p}:creator></deep>
 <title>not this</title><x:first-page>3</x:first-page><x:last-page>9</x:last-page></core></a>"""


def test_id_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        "S01.xml\tAbstractThe cat\nX1.xml\ta\nS02.xml\ta\tb\nS03.xml\tb\t\nS04.xml\t\nS05\tc\n"
    )
    rows = tables.scan_id_text(spark, str(tmp_path))
    assert tuples(rows) == [("S01", "The cat"), ("S03", "b")]


def test_article_fields_ignore_quotes(spark, tmp_path):
    header = "\t".join(tables.ARTICLE_FIELDS)
    (tmp_path / "a.tsv").write_text(
        f'{header}\nS1\t"Open\t-\t1\tJ\t-\tbody "x\t-\nS2\tT\t-\t2\tK\t-\tb2\t-\n'
    )
    path = str(tmp_path)
    assert tuples(tables.scan_tsv_field(spark, path)) == [("S1", 'body "x'), ("S2", "b2")]
    assert tuples(tables.scan_tsv_field(spark, path, "title")) == [("S1", '"Open'), ("S2", "T")]
    assert tuples(tables.scan_tsv_field(spark, path, "journal")) == [("S1", "J"), ("S2", "K")]
    plan = tables.scan_tsv_field(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pii:string,abstract:string>" in plan


def test_index_articles_need_all_fields_and_an_id(spark, tmp_path):
    header = "\t".join(tables.ARTICLE_FIELDS)
    (tmp_path / "a.tsv").write_text(
        f"{header}\nS1\tt\t-\t1\tJ\t-\tb\t-\n\tt\t-\t1\tJ\t-\tb\t-\nS2\tt\nS3\tt\t-\t1\tJ\t-\tb\t\n"
    )
    assert tuples(search.scan_index_articles(spark, str(tmp_path)), "doc_id") == [("S1",), ("S3",)]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("the  a\nthe\n\n b\n")
    assert tuples(tables.scan_terms(spark, str(tmp_path))) == [("a",), ("b",), ("the",)]
    assert tuples(tables.scan_lines(spark, str(tmp_path)))[1:] == [(" b",), ("the",), ("the  a",)]


def test_categories(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Journal\tISSN\tCat\tx\nJ\t1234-5678\tC\t\n")
    assert tuples(tables.scan_categories(spark, str(tmp_path))) == [("J", "1234-5678", "C")]


def test_loaders(spark, tmp_path):
    rows = spark.createDataFrame([("d1", ["a", "b"])], tables.SENTENCES)
    sinks.save_if(rows, str(tmp_path / "s"))
    assert tables.load_tokens(spark, str(tmp_path / "s")).first()["terms"] == ["a", "b"]
    pairs = spark.createDataFrame([("t", "d1")], tables.TOKEN_PAIRS)
    pairs.write.parquet(str(tmp_path / "p"))
    assert tuples(tables.load_token_pairs(spark, str(tmp_path / "p"))) == [("t", "d1")]
    vecs = spark.createDataFrame([("t", [1.0, 2.0])], tables.WORD_VECTORS)
    vecs.write.parquet(str(tmp_path / "v"))
    assert tables.load_word_vectors(spark, str(tmp_path / "v")).first()["vec"] == [1.0, 2.0]
    cats = spark.createDataFrame([("1", ["A"], [1])], tables.JOURNAL_CATEGORIES)
    cats.write.parquet(str(tmp_path / "c"))
    assert tables.load_categories(spark, str(tmp_path / "c")).first()["hot"] == [1]


def test_xml_by_namespace(spark):
    files = spark.createDataFrame(
        [("1.xml", ARTICLE.format(p="dc")), ("2.xml", ARTICLE.format(p="q")),
         ("3.xml", "<broken>"), ("4.xml", "<a><b/></a>"), ("5.xml", None)],
        "file_name string, x string",
    )
    got = xml.extract_xml_fields(files, ["PII", "Title", "Authors", "Pages", "ISSN"])
    fields = ("S000112X", "A & B", "One Two", "3-9", "")
    assert tuples(got) == [("1.xml", *fields), ("2.xml", *fields)]
    # Without the id, a document that lacks one is as good as any other.
    assert tuples(xml.extract_xml_fields(files, ["Title"]), "file_name") == [
        ("1.xml",), ("2.xml",), ("4.xml",)
    ]


def test_xml_tree(spark, tmp_path):
    for folder, name in (("b", "S1.xml"), ("a", "S1.xml"), ("a", "S2.xml"), ("a", "note.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"<a>\n<pii>{folder}</pii></a>")
    files = xml.scan_xml(spark, str(tmp_path), r"^S.*\.xml$")
    assert files.count() == 3
    once = xml.dedupe_by_name(files)
    got = xml.extract_xml_fields(once, ["PII"])
    assert tuples(got) == [("S1.xml", "a"), ("S2.xml", "a")]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a\t\tb", None, 1)], "x string, y string, n int")
    sinks.save_report(df, str(tmp_path / "plain"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "plain")).collect()] == ["a b\t\t1"]
    sinks.save_report(df, str(tmp_path / "headed"), ["x", "n"], header=True)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "headed")).collect()]
    assert set(lines) == {"x\tn", "a b\t1"}  # every file has the header


def test_stages_need_a_committed_write(spark, tmp_path):
    path, log = str(tmp_path / "stage"), []

    def note(action, where):
        log.append(action)

    (tmp_path / "stage").mkdir()
    first = sinks.materialize(spark, path, lambda: spark.range(3), note)
    second = sinks.materialize(spark, path, lambda: spark.range(9), note)
    assert (first.count(), second.count(), log) == (3, 3, ["built", "read"])


def test_named_table(spark, tmp_path):
    df = spark.range(4).select(F.col("id"))
    assert sinks.save_as_table(df, "four_rows", str(tmp_path / "t")).count() == 4
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_one_file_for_each_row_in_few_folders(spark, tmp_path):
    texts = spark.createDataFrame([(f"<a>{i}</a>", f"{i % 3}") for i in range(20)], "x string, folder string").coalesce(2)
    sinks.save_files(texts, str(tmp_path / "tree"), "folder")
    files = list((tmp_path / "tree").rglob("*.txt"))
    assert len(files) == 20 and len({f.parent for f in files}) == 3
    assert sorted(f.read_text().strip() for f in files) == sorted(f"<a>{i}</a>" for i in range(20))


def test_a_file_of_each_row_without_a_committer(spark, tmp_path):
    """The tree of Spark's writer, null and empty texts and odd folders too, and no checksum or attempt beside it."""
    rows = spark.createDataFrame([("a\nb", "x"), ("ä", "x"), (None, "y=/%"), ("", None), ("c", "")], "x string, folder string").repartition(3)
    sinks.save_files(rows, f"file://{tmp_path}/own", "folder")
    rows.write.option("maxRecordsPerFile", 1).partitionBy("folder").text(f"{tmp_path}/spark")

    def tree(root):
        files = [p for p in (tmp_path / root).rglob("*") if p.is_file() and p.suffix == ".txt"]
        return sorted((p.parent.name, p.read_bytes()) for p in files)

    assert tree("own") == tree("spark") and len(tree("own")) == 5
    assert not [p for p in (tmp_path / "own").rglob("*") if p.name.endswith(".crc") or "_temporary" in p.name]
    read = xml.scan_xml(spark, f"{tmp_path}/own", r"\.txt$")
    assert sorted(r.x for r in read.collect()) == ["\n", "\n", "a\nb\n", "c\n", "ä\n"]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    sinks.save_files(spark.range(200).selectExpr("string(id) as x", "string(id % 4) as folder"), str(tmp_path / "t"), "folder")
    found = xml.scan_xml(spark, str(tmp_path / "t"), r"\.txt$")
    assert found.count() == 200 and found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
