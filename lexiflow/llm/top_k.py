"""Exact top-k by inner product: sorted lists per dimension, read without random access.

Candidates are taken in blocks. In a block, every dimension is a list sorted by value,
read from its best end for the sign of the query's component. After reading to a depth, a
candidate's score is bounded: what was read counts in full; what was not is at most the
last value read and at least the far end of the list. A candidate whose upper bound is
below the k-th best lower bound (or the k-th best score of earlier blocks) cannot qualify.
Reading stops when few are left; their scores are then resolved in full. All queries of a
block read the same lists, so the bounds of a depth are a few matrix products.

Queries are dealt in blocks of bounded bytes, each broadcast on its own, over all
candidates. Every task returns k rows a query at most; a window picks the best of them.

Components are whole numbers; scores are exact while they fit a long. Vectors that are
null, empty or hold null components take no part, nor do null ids; a query meets vectors of
its own length only. Candidates with the query's id are left out. Of repeated query ids the
smallest vector counts; repeated candidate rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.session import stage

BLOCK_ROWS = 4096
QUERY_BYTES = 1 << 20
DEPTHS = (0.25, 0.5, 0.75, 1.0)
FEW = 0.02  # share of pairs left at which reading stops
FOUND = "query_id long, vec_id long, score long"


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)  # k-th score, once there are k

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        query, score, ids = query[fresh], score[fresh], ids[fresh]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Add the block's qualifying candidates to best."""
    exact = np.float64 if int(np.abs(queries).max()) * int(np.abs(rows).max()) * rows.shape[1] < 1 << 53 else None
    pairs = _bounded(queries, query_ids, rows, ids, best) if exact else np.nonzero(query_ids[:, None] != ids)
    for part in np.array_split(np.arange(len(pairs[0])), len(pairs[0]) // 200_000 + 1):
        q, c = pairs[0][part], pairs[1][part]
        best.add(q, np.einsum("ij,ij->i", queries[q], rows[c]), ids[c])


def _bounded(queries, query_ids, rows, ids, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the bounds do not rule out."""
    rows = rows.astype(np.float64)
    lists = np.sort(rows, axis=0)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    n, k = len(rows), best.k
    alive = query_ids[:, None] != ids
    for depth in DEPTHS:
        read = min(n, max(k, int(np.ceil(depth * n))))
        high, low = lists[n - read], lists[read - 1]  # the last values read from either end
        upper = up @ np.maximum(rows, high).T + down @ np.minimum(rows, low).T
        least = best.least
        if n > k:
            lower = up @ np.where(rows >= high, rows, lists[0]).T + down @ np.where(rows <= low, rows, lists[-1]).T
            lower[~alive] = -np.inf
            least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
        alive &= upper >= least[:, None]
        if alive.mean() <= FEW:
            break
    return np.nonzero(alive)


def _matrices(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and rows by vector length."""
    lengths = np.array([len(v) for v in vectors])
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = (np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.int64))
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score from queries (query_id, vector) and candidates (vec_id, vector of longs)."""
    spark = candidates.sparkSession
    usable = F.size("vector") > 0
    usable = usable & F.forall("vector", lambda x: x.isNotNull())
    queries = queries.filter(usable & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("vector").alias("vector"))
    queries = stage(queries, "queries")
    candidates = candidates.filter(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "vector")
    size = queries.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    blocks = -(-size // query_bytes)
    parts = None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        asked = spark.sparkContext.broadcast(_matrices([r.query_id for r in rows], [r.vector for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(own), k) for n, (own, _) in asked.value.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    for n, (ids, vectors) in _by_length(part).items():
                        if n in best:
                            own, matrix = asked.value[n]
                            search_block(matrix, own, vectors, ids, best[n])
            for n, found in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.value[n][0][found.query]), pa.array(found.ids), pa.array(found.score)],
                    names=["query_id", "vec_id", "score"],
                )

        found = candidates.mapInArrow(run, FOUND)
        parts = found if parts is None else parts.union(found)
    if parts is None:
        parts = spark.createDataFrame([], FOUND)
    ordered = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = parts.distinct().withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    lengths = vectors.value_lengths().to_numpy()
    values = vectors.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    return {
        int(n): (ids[at], values[starts[at][:, None] + np.arange(n)])
        for n in np.unique(lengths)
        for at in [np.flatnonzero(lengths == n)]
    }
