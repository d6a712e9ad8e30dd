"""How far the sources of a language differ in their terms: a frequent-pattern tree of term rows.

A term's row is the list of its (source, count), zeros left out, in the order of the sources.
Two sources differ by V (number of terms) times the value of two zero counts, plus a
correction for every term that occurs in either. Corrections for one count against a zero
need only the histogram of counts of a source. Corrections for two nonzero counts come from
the tree: rows are inserted with their multiplicity, equal beginnings share nodes, and every
combination of a node with an ancestor is worked out once, times the rows below the node.

The tree is never held whole. Distinct rows are dealt by ranges and sorted, so a task walks
the tree in depth-first order with one path in memory: when the next row leaves the path,
the nodes behind the fork are complete and their corrections are added up. A node cut by
the border of two tasks is worked out in both with its share of the rows; sums stay right.

All arithmetic is in whole numbers. Null lang, source and text count as ''. Repeated rows are
documents of their own, ids are not read, nor are other columns. Long texts are taken whole.
A language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.joins import lookup_join
from lexiflow.session import spread, stage

MIN_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
KNOWN_TERMS = 1 << 19  # counted terms a task holds before it sends them on
PAIR_CELLS = 1 << 22  # sums of pairs a task holds before it sends them on
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
PAIR_SUMS = "lang string, i int, j int, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; a row without a term for each group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                occurring, documents = seen[langs[i], sources[i]]
                terms = text.as_py().encode().translate(LETTERS).split()
                before = len(occurring)
                occurring.update(terms)
                documents.update(set(terms))
                held += len(occurring) - before
                if held > KNOWN_TERMS:
                    yield from map(_counted, seen.items())
                    seen.clear()
                    held = 0
        yield from map(_counted, seen.items())

    return spread(texts).mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(entry) -> pa.RecordBatch:
    (lang, source), (occurring, documents) = entry
    terms = pa.array([None, *occurring], pa.binary()).cast(pa.string())
    size = len(terms)
    arrays = [pa.array([lang]).take(pa.array([0] * size)), pa.array([source]).take(pa.array([0] * size)), terms]
    arrays += [pa.array([0, *occurring.values()], pa.int64()), pa.array([0, *map(documents.__getitem__, occurring)], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); null where there are no terms."""
    whole = f"(cast({n} as decimal(27,0)) + 2) * {SCALE}"
    return F.expr(f"1 + ({whole}) div nullif(cast({total} + 2 * {terms} as decimal(38,0)), 0)").cast("long")


def gap(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two shares."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


# --- the tree -------------------------------------------------------------------------


class PairSums:
    """Sums by (i, j), merged when many wait."""

    def __init__(self):
        self.keys, self.values, self.size = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        self.keys.append((i << 32) + j)
        self.values.append(value)
        self.size += len(value)

    def merge(self) -> int:
        """How many pairs are left after merging."""
        if self.keys:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate(self.values))
            self.keys, self.values, self.size = [keys], [sums], len(keys)
        return self.size

    def take(self, lang: str) -> Iterator[pa.RecordBatch]:
        if self.merge():
            keys, sums = self.keys[0], self.values[0]
            arrays = [pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int64)))]
            arrays += [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "i", "j", "value"])
        self.__init__()


class Tree:
    """The path of the last row: source, share and share of a zero count of its nodes, and the rows through each."""

    def __init__(self, sums: PairSums):
        self.sums = sums
        self.k = self.p = self.p0 = self.rows = np.zeros(0, np.int64)

    def insert(self, k: np.ndarray, p: np.ndarray, p0: np.ndarray, times: int) -> None:
        n = min(len(k), len(self.k))
        differs = np.flatnonzero((k[:n] != self.k[:n]) | (p[:n] != self.p[:n]))
        shared = int(differs[0]) if len(differs) else n
        self.close(shared)
        self.k, self.p, self.p0 = k, p, p0
        self.rows = np.concatenate([self.rows[:shared] + times, np.full(len(k) - shared, times)])

    def close(self, depth: int = 0) -> None:
        """Add the corrections of the nodes below a depth with all their ancestors."""
        i, j = np.tril_indices(len(self.k), -1)
        keep = i >= depth
        i, j = i[keep], j[keep]
        if len(i):
            p, p0, q, q0 = self.p[i], self.p0[i], self.p[j], self.p0[j]
            correction = gaps(p, q) - gaps(p, q0) - gaps(p0, q) + gaps(p0, q0)
            self.sums.add(self.k[j], self.k[i], correction * self.rows[i])


def tree_sums(rows: DataFrame) -> DataFrame:
    """lang, i, j, value from (lang, items of (k, p, p0) by k, times): sums of the corrections of i < j."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lang = PairSums(), None
        tree = Tree(sums)
        for batch in batches:
            langs, times, items = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())]).tolist()
            k, p, p0 = (f.to_numpy().astype(np.int64) for f in items.flatten().flatten())
            for n in range(batch.num_rows):
                if langs[n] != lang:
                    tree.close()
                    yield from sums.take(lang)
                    tree, lang = Tree(sums), langs[n]
                part = slice(bounds[n], bounds[n + 1])
                tree.insert(k[part], p[part], p0[part], int(times[n]))
                if sums.size > PAIR_CELLS and sums.merge() > PAIR_CELLS // 2:
                    yield from sums.take(lang)
        tree.close()
        yield from sums.take(lang)

    ordered = rows.select("lang", "items", "times").repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
    return ordered.mapInArrow(walk, PAIR_SUMS).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


# --- the audit ------------------------------------------------------------------------


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text).

    Part `pair` has every other source of the language, part `term` the terms that a source
    uses more than its language does, up to a rank.
    """
    counts = stage(term_counts(docs), "term-counts")
    found = counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
    found = found.agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("row"))
    rows = stage(found.where(F.col("docs") >= min_docs).drop("docs"), "term-rows")
    groups = stage(_groups(counts, rows), "groups")
    cells = lookup_join(rows.select("lang", "term", "lang_n", F.inline("row")), groups, ["lang", "source"])
    cells = stage(cells.withColumn("p", share("n", "total", "terms")), "cells")
    return _pairs(groups, cells).unionByName(_terms(cells, top_terms))


def _groups(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, k, total, terms, lang_total, p0: each group, numbered in its language by falling total."""
    totals = rows.select("lang", F.inline("row")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    every = counts.where(F.col("term").isNull()).select("lang", "source")
    every = every.join(totals, ["lang", "source"], "left").join(F.broadcast(langs), "lang", "left").na.fill(0)
    order = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    return every.select("*", F.row_number().over(order).alias("k"), share("0", "total", "terms").alias("p0"))


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("k", "p", "p0"))).alias("items")
    rows = cells.groupBy("lang", "term").agg(items).groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    both = tree_sums(rows).select("lang", F.col("i").alias("low"), F.col("j").alias("high"), "value")

    shares = cells.groupBy("lang", "k", "p").agg(F.count(F.lit(1)).alias("times"))
    shares = shares.groupBy("lang", "k").agg(F.collect_list(F.struct("p", "times")).alias("shares"))
    one = groups.select("lang", "k", "p0", "terms").join(shares, ["lang", "k"], "left")
    other = groups.select("lang", F.col("k").alias("other"), F.col("p0").alias("q0"))
    sided = lookup_join(one, other, "lang").where("k <> other")
    alone = F.expr(
        "aggregate(coalesce(shares, array()), 0L, (sum, s) -> sum + s.times * ("
        "(s.p - q0) * (s.p - q0) div (s.p + q0) - (p0 - q0) * (p0 - q0) div (p0 + q0)))"
    )
    zeros = F.when(F.col("k") < F.col("other"), F.col("terms") * gap("p0", "q0")).otherwise(0)
    sided = sided.select(
        "lang", F.least("k", "other").alias("low"), F.greatest("k", "other").alias("high"), F.coalesce(alone + zeros, F.lit(0)).alias("value")
    )
    pairs = sided.unionByName(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("low").alias("k"), F.col("high").alias("other")), F.struct(F.col("high").alias("k"), F.col("low").alias("other")))
    pairs = pairs.select("lang", "value", F.inline(ways))
    pairs = lookup_join(pairs, groups.select("lang", "k", "source"), ["lang", "k"])
    pairs = lookup_join(pairs, groups.select("lang", F.col("k").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    return _ranked(pairs, "pair")


def _terms(cells: DataFrame, top_terms: int) -> DataFrame:
    terms = cells.withColumn("q", share("lang_n", "lang_total", "terms")).where("p > q and n > 0")
    terms = terms.select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    return _ranked(terms, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
