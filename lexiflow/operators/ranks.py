"""Numbering rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.session import stage


def number_rows(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the position of each row in the order, from 0.

    Rows are dealt out by ranges of the order and stored with the number of their range;
    a window over the ranges, as many rows as there are tasks, gives where each begins.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    begins = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_place", inside).join(F.broadcast(begins), "_range")
    return placed.withColumn(name, F.col("_begin") + F.col("_place")).drop("_range", "_begin", "_place")
