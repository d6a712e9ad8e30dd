"""Remove boilerplate lines that are spread over many distinct sites.

A line counts by its trimmed text. A HyperLogLog sketch of the sites of each line hash is
merged by aggregation. Lines whose estimate is well above the threshold are boilerplate;
lines near it get an exact distinct count of their sites. The first occurrence of a
boilerplate line in the corpus (smallest doc_id, then position) stays, all others go.

A line that is in a third of all documents is one sketch per task in the aggregation, and
a skewed key of plain joins between stored tables, which adaptive execution splits. What
is regrouped is the positions to drop within one document.

Blank lines are never boilerplate. A null source is a site of its own; a null id comes last.
A null text stays null. Rows equal in doc_id and text lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage

MIN_SITES = 6
SKETCH_LG = 12  # 4,096 registers: relative error about 1.6 percent
NEAR = 0.1  # six standard errors around the threshold
NO_SITE = "\x00"


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, site, at, high, low: one row per line with text."""
    line = F.trim("line")
    return (
        docs.select(
            F.xxhash64("doc_id", "text").alias("row"),
            "doc_id",
            F.coalesce("source", F.lit(NO_SITE)).alias("site"),
            F.posexplode(F.split("text", "\n")).alias("at", "line"),
        )
        .filter(line != "")
        .select("row", "doc_id", "site", "at", F.xxhash64(line).alias("high"), F.hash(line).alias("low"))
    )


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(high, low) hashes of the lines on at least min_sites distinct sites."""
    lines = _lines(docs)
    band = max(1.0, NEAR * min_sites)
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LG)))
    wide = stage(
        lines.groupBy("high", "low").agg(spread.alias("sites")).filter(F.col("sites") >= min_sites - band), "wide"
    )
    sure = wide.filter(F.col("sites") > min_sites + band).select("high", "low")
    near = wide.filter(F.col("sites") <= min_sites + band).select("high", "low")
    exact = (
        lines.select("high", "low", "site")
        .join(near, ["high", "low"])
        .distinct()
        .groupBy("high", "low")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("high", "low")
    )
    return stage(sure.union(exact), "boilerplate")


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """doc (the row), text without its boilerplate lines, n_lines, n_removed."""
    found = boilerplate_lines(docs, min_sites)
    hits = stage(_lines(docs).join(found, ["high", "low"]).select("row", "doc_id", "at", "high", "low"), "hits")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")
    first = stage(hits.groupBy("high", "low").agg(F.min(place).alias("first")), "first")
    again = hits.join(first, ["high", "low"]).filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    drops = stage(again.groupBy("row").agg(F.collect_set("at").alias("drop")), "drops")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct("*").alias("doc"))
    met = keyed.join(drops.hint("merge"), "row", "left")
    parts = F.split("doc.text", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains("drop", i))
    full = F.size(F.filter(parts, lambda x: F.trim(x) != ""))
    return met.select(
        "doc",
        F.when(F.col("drop").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(full).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text rewritten, and the columns n_lines (with text) and n_removed, which replace columns of these names."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    columns = [F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in names]
    return _cleaned(docs, min_sites).select(*columns, "n_lines", "n_removed")


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The same columns with text and n_chars rewritten; a document that loses all its text goes."""
    cleaned = _cleaned(docs, min_sites)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("doc")["n_chars"])
    rewritten = {"text": F.col("text"), "n_chars": n_chars.cast("long").alias("n_chars")}
    columns = [rewritten.get(c, F.col("doc")[c].alias(c)) for c in docs.columns]
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).select(*columns)
