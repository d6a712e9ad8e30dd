"""Mix sources to target weights by systematic sampling, in DataFrame functions only.

Targets share all words of the corpus by weight; a target stops at a multiple of its
source's size and the excess goes to the others by weight. Every document of a source has
the same expected number of copies, target / size. The expected copies are prefix-summed
within the source, one random offset is added, and a document is emitted once per integer
boundary its interval crosses. Of OFFSETS random offsets the one whose words come nearest
to the target is used.

The order is by size, so that the words taken stay close to the target, then by a hash of
the id. The prefix sum is a histogram: counts by (source, size), split by hash into blocks
of about BLOCK documents, are summed by window; a window inside one block gives the rest.
A source or size that holds most of the corpus is thus spread over many tasks.

Null texts have size 0. A null source is a source of its own, last in order. Rows that
repeat an id are documents of their own. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.session import stage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 1000
OFFSETS = 16  # random offsets tried; the one that comes nearest to the target is used
UNIT_BITS = 24  # expected copies are whole numbers of 2 ** -24
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row per source.

    Sources by code point, null last, take the weights in turn. Sorted by size / weight,
    the sources that reach their limit come first: a running sum finds them in one pass.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long")
    limit = F.lit(most) * F.col("source_size")
    full_first = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        totals.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("limit") / F.col("weight") <= F.col("left") / F.col("weights"))
    )
    open_rows = F.when(~F.col("full"), F.struct(F.col("left"), F.col("weights")))
    rows = rows.withColumn("level", F.max_by(open_rows, F.when(~F.col("full"), F.col("weights"))).over(everything))
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weights").cast("double")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row of docs."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("draw")), "sized"
    )
    offsets = [
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
        for k in range(OFFSETS)
    ]
    targets = stage(
        source_targets(sized, weights, most)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("expected", F.floor(F.col("ratio") * (1 << UNIT_BITS)).cast("long"))
        .withColumn("offsets", F.array(*offsets)),
        "targets",
    )
    part = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
    groups = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    keyed = sized.join(
        groups.select(F.col("source").alias("s"), F.col("size").alias("z"), blocks.alias("blocks")),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).select("doc_id", "source", "size", "draw", F.floor(part * F.col("blocks")).alias("block"))
    keyed = stage(keyed, "keyed")
    counted = keyed.groupBy("source", "size", "block").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("sizes_before")
    )
    starts = counted.select("source", "size", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("blocks_before"))
    starts = starts.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    starts = stage(
        starts.select(
            F.col("source").alias("s"),
            F.col("size").alias("z"),
            F.col("block").alias("k"),
            (F.col("sizes_before") + F.col("blocks_before")).alias("first"),
        ),
        "starts",
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("draw", "doc_id"))
    ranked = keyed.withColumn("rank", rank)
    placed = ranked.join(
        starts,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("block") == F.col("k")),
    ).drop("s", "z", "k")
    ends = stage(
        placed.join(
            targets.select(F.col("source").alias("t"), "source_size", "target", "expected"), F.col("source").eqNullSafe(F.col("t"))
        ).select(
            "doc_id", "source", "size", "source_size", "target", "expected",
            ((F.col("first") + F.col("rank")) * F.col("expected")).alias("end"),
        ),
        "ends",
    )

    def copies(offset: Column) -> Column:
        end = F.col("end") + offset
        return F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("expected"), UNIT_BITS)

    tried = targets.select(F.col("source").alias("t"), "offsets")
    met = ends.join(tried, F.col("source").eqNullSafe(F.col("t")))
    taken = met.groupBy("source", "target").agg(
        *[F.sum(copies(F.col("offsets")[k]) * F.col("size")).alias(f"taken{k}") for k in range(OFFSETS)]
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k")) for k in range(OFFSETS)])
    best = stage(taken.select("source", F.array_min(misses)["k"].alias("k")), "best")
    chosen = targets.join(best.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    chosen = chosen.select(F.col("source").alias("t"), F.element_at("offsets", F.col("k") + 1).alias("offset"))
    return ends.join(chosen, F.col("source").eqNullSafe(F.col("t"))).select(
        "doc_id", "source", "size", "source_size", "target", copies(F.col("offset")).cast("long").alias("copies")
    )
