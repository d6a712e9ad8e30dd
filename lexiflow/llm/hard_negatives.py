"""Hard negatives by slots: one pass over the rows answers all windows of an anchor.

Every positive of an anchor asks for the best rows of another label whose score lies in a
window below its own. The windows of an anchor overlap, but their upper limits, sorted
downwards, cut the scores into disjoint slots: slot j holds the scores above the next limit
and up to limit j. A task keeps the best few rows of each slot (the combiner); Spark merges
them by (anchor, slot). A suffix merge from the lowest slot upwards then gives the best rows
at or below every limit, and a window is the head of its suffix, cut at its lower limit. So
a row is stored once however many windows it lies in, and each task sends at most
`positives * negatives` rows an anchor.

Anchors are taken in blocks of bounded bytes. A block is broadcast to all rows twice: to find
its positives, and with their limits to fill the slots. Each block's result is written before
the next begins, so plan and driver memory do not grow with the number of blocks.

Labels and vectors that are null, vectors with null components and null ids take no part.
Vectors meet those of their own length, empty ones score 0. A positive with a negative score
has an empty window. Equal scores go by the smaller id. Repeated rows count once; of anchors
with one id the smallest (label, vector) counts; rows with the anchor's id are never its
positive. Components and labels are whole numbers; 100 times a score must fit a long. Other
columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexiflow.session import fresh_path, stage

ANCHOR_BYTES = 4 << 20
BLOCK_ROWS = 2048
EXACT = 1 << 53  # whole numbers up to here are exact as doubles
PAIRS = 1 << 18  # kept pairs at which a task merges
SCORED = "group long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Heads:
    """The k best (score, smaller id first) of each group so far."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min)  # k-th score, once there are k
        self.kept = (np.zeros(0, np.int64),) * 3  # group, score, id
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[group]
        self.waiting.append((group[good], score[good], ids[good]))
        self.size += int(good.sum())
        if self.size > PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        group, score, ids = (np.concatenate(parts) for parts in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        fresh = np.ones(len(group), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        group, score, ids = group[fresh], score[fresh], ids[fresh]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        good = place < self.k
        self.kept = group[good], score[good], ids[good]
        last = place[good] == self.k - 1
        self.least[self.kept[0][last]] = self.kept[1][last]
        self.waiting, self.size = [], 0
        return self.kept


def _by_length(lengths: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


class Anchors:
    """A block of anchors: ids, labels, vectors by length, and the limits of their slots."""

    def __init__(self, rows: list):
        self.ids = np.array([r.anchor_id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        lengths = np.array([len(r.vector) for r in rows], np.int64)
        values = np.array([x for r in rows for x in r.vector], np.int64)
        self.by_length = {matrix.shape[1]: (at, matrix) for at, matrix in _by_length(lengths, values)}
        self.limits = self.floor = None

    def set_limits(self, limits: np.ndarray, floor: np.ndarray) -> None:
        """limits: anchors x slots, downwards, padded with the least long."""
        self.limits, self.floor = limits, floor


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < EXACT:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def _pairs(block: Anchors, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor places, scores, same label, rows' ids) for the rows of each length."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    vectors = batch.column(2)
    for at, matrix in _by_length(vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()):
        if matrix.shape[1] in block.by_length:
            own, asked = block.by_length[matrix.shape[1]]
            yield own, _scores(asked, matrix), block.labels[own][:, None] == labels[at], ids[at]


def _heads(rows: DataFrame, block: Anchors, k: int, groups: int, choose) -> DataFrame:
    """The k best rows of each group (group, vec_id, score), kept by tasks first."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Heads(groups, k)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                for pairs in _pairs(shared.value, batch.slice(start, BLOCK_ROWS)):
                    best.add(*choose(shared.value, *pairs))
        group, score, ids = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids), pa.array(score)], names=["group", "vec_id", "score"])

    order = Window.partitionBy("group").orderBy(F.col("score").desc(), "vec_id")
    found = rows.mapInArrow(run, SCORED).distinct().withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= k)


def _same_label(block: Anchors, own, scores, same, ids):
    a, r = np.nonzero(same & (block.ids[own][:, None] != ids))
    return own[a], scores[a, r], ids[r]


def _in_slots(block: Anchors, own, scores, same, ids):
    """Rows of another label by slot: how many limits lie at or above the score."""
    limits = block.limits[own]
    a, r = np.nonzero(~same & (scores <= limits[:, :1]) & (scores >= block.floor[own][:, None]))
    score = scores[a, r]
    slot = (limits[a] >= score[:, None]).sum(axis=1) - 1
    return own[a] * limits.shape[1] + slot, score, ids[r]


def _suffix_merges(slots: int, k: int):
    """Column: for each slot the k best of it and of all lower ones, from the lowest upwards."""
    kind = "array<struct<score:bigint,vec_id:bigint>>"

    def merge(merged, slot):
        own = F.transform(
            F.filter("heads", lambda h: h["slot"] == slot), lambda h: F.struct(h["score"].alias("score"), h["vec_id"].alias("vec_id"))
        )
        below = F.coalesce(F.get(merged, F.lit(0)), F.array().cast(kind))
        return F.concat(F.array(F.slice(F.concat(own, below), 1, k)), merged)

    return F.aggregate(F.sequence(F.lit(slots - 1), F.lit(0), F.lit(-1)), F.array().cast(f"array<{kind}>"), merge)


def hard_negatives(
    anchors: DataFrame,
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    From anchors (anchor_id, label, vector of longs) and rows (vec_id, label, vector of longs).
    For each anchor's best `positives` rows of its label, the best `negatives` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    whole = F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    anchors = anchors.where(whole & F.col("anchor_id").isNotNull()).groupBy("anchor_id")
    smallest = F.min(F.struct(F.col("label").cast("long").alias("label"), "vector"))
    anchors = stage(anchors.agg(smallest.alias("a")).select(F.col("anchor_id").cast("long"), "a.label", "a.vector"), "anchors")
    kept = rows.where(whole & F.col("vec_id").isNotNull())
    kept = stage(kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), "vector"), "rows")
    size = anchors.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    blocks = -(-size // anchor_bytes)
    path = fresh_path(spark, "negatives")
    for part in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)) == part).collect()
        if own:
            found = _negatives_of(kept, Anchors(own), positives, negatives, low, high)
            found.write.mode("append").parquet(path)
    if not blocks:
        spark.createDataFrame([], RESULT).write.parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _negatives_of(rows: DataFrame, block: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, none = rows.sparkSession, np.iinfo(np.int64).min
    found = _heads(rows, block, positives, len(block.ids), _same_label).collect()  # a few of each anchor of the block
    limits = np.full((len(block.ids), positives), none)
    floor = np.full(len(block.ids), np.iinfo(np.int64).max)
    windows = []
    for r in sorted(found, key=lambda r: (r.group, r.place)):  # by falling score, so limits fall too
        if r.score >= 0:
            at, limit = r.group, r.score * high // 100
            slot = int((limits[at] > max(limit, none + 1)).sum())
            limits[at, slot] = limit
            floor[at] = min(floor[at], -(-r.score * low // 100))
            windows.append((at, int(block.ids[at]), slot, r.vec_id, r.score, -(-r.score * low // 100)))
    block.set_limits(limits, floor)
    heads = _heads(rows, block, negatives, limits.size, _in_slots)
    slot = (F.col("group") % positives).cast("int").alias("slot")
    head = F.struct(slot, (-F.col("score")).alias("falling"), "vec_id", "score")
    merged = heads.groupBy(F.floor(F.col("group") / positives).alias("at")).agg(F.sort_array(F.collect_list(head)).alias("heads"))
    merged = merged.select("at", _suffix_merges(positives, negatives).alias("suffixes"))
    asked = spark.createDataFrame(windows, "at long, anchor_id long, slot int, positive_id long, positive_score long, least long")
    inside = F.filter(F.get("suffixes", F.col("slot")), lambda h: h["score"] >= F.col("least"))
    listed = merged.join(F.broadcast(asked), "at").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("n", "h"))
    return listed.select(
        "anchor_id",
        "positive_id",
        (F.col("n") + 1).cast("int").alias("rank"),
        F.col("h.vec_id").alias("negative_id"),
        "positive_score",
        F.col("h.score").alias("negative_score"),
    )
