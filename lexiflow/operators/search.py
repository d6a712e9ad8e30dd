"""Ranked term search over postings tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.functions import text as X
from lexiflow.operators.joins import lookup_join
from lexiflow.operators.ranks import number_rows
from lexiflow.session import shuffles_removed, spread, stage
from lexiflow.sources.tables import ARTICLE_FIELDS

TEXT_FIELDS = ("title", "journal", "abstract")
# Scores are compared at about single precision, so that equal texts tie and go by id.
SCORE_DIGITS = 6
# More asked terms than this are joined instead of listed in the filter of the scan.
TERMS_IN_FILTER = 2_000
# Documents of one range: their set is the bits of a long.
RANGE_DOCS = 64
# Words made into postings at once.
WORDS_AT_ONCE = 500_000


def scan_index_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article lines with all eight fields and an id; the header line is not an article."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    full = cells.where(F.size("f") == len(ARTICLE_FIELDS))
    named = full.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(ARTICLE_FIELDS)])
    rows = named.where((F.col("pii") != "") & (F.col("pii") != ARTICLE_FIELDS[0]))
    return index_documents(rows.withColumnRenamed("pii", "doc_id"))


def index_documents(articles: DataFrame) -> DataFrame:
    """Stored originals (doc_id, title, issn, journal, abstract) with a folded id.

    The folded id is a column of its own, so that a lookup is a pushed-down filter.
    """
    return articles.where(F.coalesce("doc_id", F.lit("")) != "").select(
        "doc_id", "title", "issn", "journal", "abstract", F.lower("doc_id").alias("id_key")
    )


def _search_terms(token_column: str, stop_words: Sequence[str]):
    token = F.col(token_column)
    return ~token.isin(*stop_words) if stop_words else F.lit(True)


def build_postings(
    documents: DataFrame,
    fields: Sequence[str] = TEXT_FIELDS,
    stop_words: Sequence[str] = P.SEARCH_STOP_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(field, term, doc_id, freq, positions, offsets, doc_len).

    Stop words are not indexed but keep their position. The issn is one term with
    neither positions nor offsets. Columns of `keep` follow, one value for each id. The words
    of a text stay together until they are postings, so that nothing larger than the texts is
    sorted or exchanged; documents partitioned by id are not exchanged at all. Several
    texts of one id are read beside each other, place by place.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in fields])
    rows = documents.select("doc_id", *keep, F.inline(texts))
    bodies = rows.groupBy("doc_id", *keep, "field").agg(F.collect_list("body").alias("bodies"))
    hits = F.transform("bodies", lambda b: X.matches(b, P.WORD_RUN))
    gaps = F.transform("bodies", lambda b: F.transform(F.split(b, P.WORD_RUN, -1), F.length))
    read = bodies.select("doc_id", *keep, "field", hits.alias("hits"), F.flatten(gaps).alias("gaps")).select(
        "doc_id", *keep, "field",
        F.transform("hits", F.size).alias("sizes"),
        F.transform(F.flatten("hits"), F.lower).alias("terms"),
        F.transform(F.flatten("hits"), F.length).alias("lengths"),
        "gaps",
    )
    types = dict(documents.dtypes)
    schema = ", ".join([
        "field string", "term string", f"doc_id {types['doc_id']}", "freq bigint", "positions array<int>",
        "offsets array<struct<start:int,end:int>>", "doc_len bigint", *(f"{name} {types[name]}" for name in keep),
    ])
    words = read.mapInArrow(_posted(frozenset(stop_words), tuple(keep)), schema)
    issn = documents.where(F.coalesce("issn", F.lit("")) != "").select(
        F.lit("issn").alias("field"),
        F.col("issn").alias("term"),
        "doc_id",
        F.lit(1).cast("bigint").alias("freq"),
        F.array().cast("array<int>").alias("positions"),
        F.array().cast("array<struct<start:int,end:int>>").alias("offsets"),
        F.lit(1).cast("bigint").alias("doc_len"),
        *keep,
    )
    return words.unionByName(issn)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _posted(stop_words: frozenset[str], keep: tuple[str, ...]):
    """Rows (doc_id, field, words and gaps of its texts) -> postings, by sorts of whole batches of words."""
    names = ["field", "term", "doc_id", "freq", "positions", "offsets", "doc_len", *keep]

    def post(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts = rows["sizes"].flatten().to_numpy()  # words of each text
        text_row = np.repeat(np.arange(len(rows)), rows["sizes"].value_lengths().to_numpy())
        begins = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(counts)), counts)
        row, pos = text_row[text], np.arange(len(text)) - begins[text]
        length = rows["lengths"].flatten().to_numpy()
        gap = rows["gaps"].flatten().to_numpy()[np.arange(len(text)) + text]  # a text has one gap more than words
        order = np.lexsort((pos, row))
        row, pos, length = row[order], pos[order], length[order]
        end = np.cumsum(gap[order] + length)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        end -= np.repeat(end[first] - gap[order][first] - length[first], np.diff(np.append(first, len(row))))
        coded = rows["terms"].flatten().dictionary_encode()
        code, spelled = coded.indices.to_numpy()[order], coded.dictionary
        indexed = np.array([term not in stop_words for term in spelled.to_pylist()], bool)[code]
        row, pos, start, end, code = (x[indexed] for x in (row, pos, end - length, end, code))
        doc_len = np.bincount(row, minlength=len(rows))
        order = np.lexsort((end, start, pos, code, row))
        row, pos, start, end, code = (x[order] for x in (row, pos, start, end, code))
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        of = pa.array(row[first])
        places = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end)], ["start", "end"])
        columns = [
            rows["field"].take(of), spelled.take(pa.array(code[first])), rows["doc_id"].take(of),
            pa.array(np.diff(np.append(first, len(row)))), _lists(pa.array(pos.astype(np.int32)), first), _lists(places, first),
            pa.array(doc_len[row[first]]), *(rows[name].take(of) for name in keep),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.cumsum([0, *batch["terms"].value_lengths().to_numpy()])
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(words, words[at] + WORDS_AT_ONCE, side="right")) - 1)
                if words[to] > words[at]:
                    yield post(batch.slice(at, to - at))
                at = to

    return run


@dataclass(frozen=True)
class SearchIndex:
    documents: DataFrame  # stored originals by folded id
    postings: DataFrame
    doc_freqs: DataFrame  # field, term, df
    stats: DataFrame  # field, docs, total_len
    ranges: DataFrame  # field, term, range, max_freq, min_len, docs (bits)


def save_index(documents: DataFrame, path: str) -> SearchIndex:
    """Store documents, postings, impacts by range, document frequencies and field statistics.

    Documents are numbered by id and cut into ranges. For every term and range the largest
    frequency and the shortest length bound the score of any document there, whatever the
    constants of a query; a long has a bit for each document that holds the term.

    Documents lie in ranges of their id: a lookup opens the few files whose statistics hold
    the key. Postings are written where the texts are read, whole document ranges to a
    file and in order of their term, so that no posting is exchanged; a search reads the pages
    of its terms of every file.
    """
    spark = documents.sparkSession
    with shuffles_removed(spark):
        documents.repartitionByRange("id_key").sortWithinPartitions("id_key").write.option("compression", "zstd").parquet(f"{path}/documents")
        stored = spark.read.schema(documents.schema).parquet(f"{path}/documents")
        numbers = stage(number_rows(stored.select("doc_id").distinct(), "_n", "doc_id"), "doc-numbers")
        places = numbers.select("doc_id", F.floor(F.col("_n") / RANGE_DOCS).alias("range"), (F.col("_n") % RANGE_DOCS).cast("int").alias("place"))
        placed = spread(lookup_join(stored, places, "doc_id"), "range")
        postings = build_postings(placed, keep=("range", "place")).sortWithinPartitions("field", "term", "doc_id")
        postings.write.option("compression", "zstd").partitionBy("field").parquet(f"{path}/postings")
        saved = spark.read.parquet(f"{path}/postings")
        freqs = saved.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        freqs.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.option("compression", "zstd").parquet(f"{path}/doc-freqs")
        field_stats(saved).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/stats")
        cells = saved.select("field", "term", "range", "freq", "doc_len", "place").repartitionByRange("field", "term", "range")
        impacts = cells.groupBy("field", "term", "range").agg(
            F.max("freq").alias("max_freq"), F.min("doc_len").alias("min_len"), F.expr("bit_or(shiftleft(1L, place))").alias("docs")
        )
        impacts.sortWithinPartitions("field", "term", "range").write.option("compression", "zstd").partitionBy("field").parquet(f"{path}/ranges")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    tables = (spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "doc-freqs", "stats", "ranges"))
    return SearchIndex(*tables)


def field_stats(postings: DataFrame) -> DataFrame:
    """(field, docs, total_len), computed once when the index is built."""
    per_doc = postings.select("field", "doc_id", "doc_len").distinct()
    return per_doc.groupBy("field").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("doc_len").alias("total_len")
    )


def index_size(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("num_docs"))


def lookup_id(documents: DataFrame, doc_id: str) -> DataFrame:
    """At most one document; case does not matter."""
    return documents.where(F.col("id_key") == doc_id.lower()).limit(1).drop("id_key")


def query_terms(queries: DataFrame, stop_words: Sequence[str] = P.SEARCH_STOP_WORDS) -> DataFrame:
    """(query_id, text) -> (query_id, term, qtf); a repeated term counts as often."""
    words = F.explode(X.matches(F.lower("text"), P.WORD_RUN))
    terms = queries.select("query_id", words.alias("term"))
    return (
        terms.where(_search_terms("term", stop_words))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _asked(index_table: DataFrame, wanted: DataFrame, field: str) -> DataFrame:
    """Rows of the field that hold an asked term; few terms become a filter of the scan."""
    listed = index_table.where(F.col("field") == field)
    terms = [row.term for row in wanted.select("term").distinct().limit(TERMS_IN_FILTER + 1).collect()]
    if len(terms) <= TERMS_IN_FILTER:
        return listed.where(F.col("term").isin(terms))
    return listed


def _tf(freq: str, length: str, mean_len: float, k1: float, b: float) -> Column:
    """Grows with the frequency, falls with the length."""
    length_part = 1 - b + b * F.col(length) / mean_len
    return F.col(freq) * (k1 + 1) / (F.col(freq) + k1 * length_part)


def _rated(index: SearchIndex, wanted: DataFrame, field: str, docs: int) -> DataFrame:
    """(query_id, term, boost) of the asked terms that the field holds."""
    freqs = _asked(index.doc_freqs, wanted, field)
    idf = F.log(1 + (float(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = wanted.join(freqs.select("term", "df"), "term")
    return stage(rated.select("query_id", "term", (F.col("qtf") * idf).alias("boost")), "rated")


def score(
    index: SearchIndex, queries: DataFrame, field: str, k1: float = P.BM25_K1, b: float = P.BM25_B
) -> DataFrame:
    """(query_id, doc_id, score) of every document with at least one query term: BM25."""
    stats = index.stats.where(F.col("field") == field).first()
    if stats is None:
        return _no_scores(queries)
    wanted = stage(query_terms(queries), "query-terms")
    rated = _rated(index, wanted, field, stats.docs)
    listed = _asked(index.postings, wanted, field)
    hits = lookup_join(listed.select("term", "doc_id", "freq", "doc_len"), rated, "term")
    return _summed(hits, stats.total_len / stats.docs, k1, b)


def _no_scores(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit("").alias("doc_id"), F.lit(0.0).alias("score")).where(F.lit(False))


def _summed(hits: DataFrame, mean_len: float, k1: float, b: float) -> DataFrame:
    total = F.round(F.sum(F.col("boost") * _tf("freq", "doc_len", mean_len, k1, b)), SCORE_DIGITS)
    return hits.groupBy("query_id", "doc_id").agg(total.alias("score"))


@dataclass(frozen=True)
class BoundedSearch:
    """A search in two readings: the ranges of the highest bounds, then those that the n-th score leaves."""

    best: DataFrame  # query_id, rank, doc_id, score
    cells: DataFrame  # query_id, term, range, boost, bound: what the queries match
    read: DataFrame  # the cells whose postings were scored


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def bounded_search(
    index: SearchIndex, queries: DataFrame, field: str, n: int, k1: float = P.BM25_K1, b: float = P.BM25_B
) -> BoundedSearch:
    """The n best documents of each query, reading only ranges that can hold one of them.

    The bound of a range is the sum over the query's terms of the highest score a document
    of the range can have. Each of the n ranges with the highest bounds holds a document at
    least, so their n-th score is one that the result reaches; a range whose bound is lower
    is ruled out without reading its postings. All sides of these joins are stored tables, so
    the planner knows their size and broadcasts the small ones only.
    """
    stats = index.stats.where(F.col("field") == field).first()
    if stats is None:
        none = _no_scores(queries).withColumn("rank", F.lit(0).cast("bigint"))
        return BoundedSearch(none, none, none)
    mean_len = stats.total_len / stats.docs
    wanted = stage(query_terms(queries), "query-terms")
    rated = _rated(index, wanted, field, stats.docs)
    highest = (F.col("boost") * _tf("max_freq", "min_len", mean_len, k1, b)).alias("bound")
    cells = lookup_join(_asked(index.ranges, wanted, field), rated, "term").select("query_id", "term", "range", "boost", highest)
    cells = stage(cells, "query-ranges")
    bounds = stage(cells.groupBy("query_id", "range").agg(F.sum("bound").alias("bound")), "bounds")
    listed = _asked(index.postings, wanted, field).select("term", "range", "doc_id", "freq", "doc_len")

    def scores(ranges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        chosen = stage(cells.join(ranges, ["query_id", "range"], "left_semi"), name)
        hits = listed.join(chosen.select("query_id", "term", "range", "boost"), ["term", "range"])
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
        scored = _summed(hits, mean_len, k1, b).withColumn("rank", place).where(F.col("rank") <= n)
        return stage(scored, "scores"), chosen

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    first = bounds.withColumn("_nth", F.row_number().over(by_bound)).where(F.col("_nth") <= n)
    first = stage(first.select("query_id", "range"), "first-ranges")
    scored, read = scores(first, "first-cells")
    least = scored.where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    rounding = 10.0**-SCORE_DIGITS
    able = bounds.join(least, "query_id").where(F.col("bound") + rounding >= F.col("least")).select("query_id", "range")
    others, read_then = scores(able.join(first, ["query_id", "range"], "left_anti"), "other-cells")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    best = scored.unionByName(others).withColumn("rank", place.cast("bigint")).where(F.col("rank") <= n)
    return BoundedSearch(best.select("query_id", "rank", "doc_id", "score"), cells, read.unionByName(read_then))


def search_batch(index: SearchIndex, queries: DataFrame, field: str, n: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the n best documents of each query."""
    return bounded_search(index, queries, field, n).best.select("query_id", "rank", "doc_id", "score")


def search(index: SearchIndex, field: str, text: str, n: int) -> DataFrame:
    """(doc_id, score, title, issn, journal, abstract, total): the n best documents for one text.

    total is the number of documents that match. Only the n best meet the stored originals.
    """
    query = index.postings.sparkSession.createDataFrame([(0, text)], "query_id bigint, text string")
    best = stage(search_batch(index, query, field, n), "best").drop("query_id")
    ids = [row.doc_id.lower() for row in best.collect()]  # n at most
    stored = index.documents.where(F.col("id_key").isin(ids)).drop("id_key")
    total = search_hits(index, query, field).agg(F.max("hits")).scalar().alias("total")
    found = best.join(F.broadcast(stored), "doc_id").orderBy("rank")
    return found.select("doc_id", "score", "title", "issn", "journal", "abstract", total)


def search_hits(index: SearchIndex, queries: DataFrame, field: str) -> DataFrame:
    """(query_id, hits): how many documents match each query, 0 included.

    The documents of a range that hold any of the terms are the bits of one long; no posting
    is read.
    """
    wanted = stage(query_terms(queries).select("query_id", "term"), "query-terms")
    listed = _asked(index.ranges, wanted, field).select("term", "range", "docs")
    sets = lookup_join(listed, wanted, "term").groupBy("query_id", "range").agg(F.bit_or("docs").alias("docs"))
    counts = sets.groupBy("query_id").agg(F.sum(F.bit_count("docs")).alias("hits"))
    return (
        queries.select("query_id")
        .distinct()
        .join(counts, "query_id", "left")
        .select("query_id", F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"))
    )
