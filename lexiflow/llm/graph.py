"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage


LINKS_IN_TASK = 100_000


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks), "least")
    least = least.select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest one."""
    least = stage(links.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks), "least")
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("least").alias("b")))


def _unfinished(links: DataFrame, tasks: int) -> bool:
    """Whether some node has two parents, or a parent that has one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counted.filter("up > 1 or (up > 0 and down > 0)").coalesce(tasks).limit(1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); the root is the smallest node reachable.

    Each round stages its links, halves the depth of the trees at least, and stops when
    every node points to a root. Null ends and loops are left out. The number of tasks
    follows the number of links; a node with very many links is a skewed key of joins
    between stored tables.
    """
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(links.filter("a != b").select(*ends).distinct(), "links")
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(partitions, max(8, links.count() // LINKS_IN_TASK))
    while _unfinished(links, tasks):
        links = stage(_large_star(links, tasks).distinct().coalesce(tasks), "large")
        links = stage(_small_star(links, tasks).distinct().coalesce(tasks), "small")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stage(links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.coalesce(tasks)), "components")
