"""Where intermediate tables go and how wide a scan runs."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_open_scopes: list[list[str]] = []  # paths made in each open `scratch` block


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="lexiflow-")
    return _local_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, when the result that reads them is written."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            remove(spark, path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths made inside, for tables that are replaced before the enclosing `scratch` ends."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield paths
    finally:
        _open_scopes.pop()
        if _open_scopes:
            _open_scopes[-1].extend(paths)


def remove_all(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        remove(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a write inside exchanges is deleted when it ends, not when the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once, read back.

    For a result with several consumers: the lineage is cut by a table that
    outlives executors, each consumer prunes its own columns, and the planner
    sees the real size instead of an estimate. The exchanges below it are deleted.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use the whole cluster for the work that follows a scan.

    With keys: hash-partition once, so that every later grouping, window or join
    on those keys needs no exchange of its own. The rows moved are the texts, not
    the many times larger exploded tokens. The configured number of partitions is given
    explicitly, because adaptive execution would merge them by the size of the texts and
    not by that of the tokens. Without keys: only a scan of fewer bytes than one task reads
    for each core is widened, by the planner's estimate; a large scan is left as it is.
    """
    if keys:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(partitions, *keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    bytes_, task_bytes = _scanned(df)
    return df if bytes_ >= cores * task_bytes else df.repartition(cores)


def _scanned(df: DataFrame) -> tuple[int, int]:
    """(the planner's estimate of the bytes, bytes that one task reads)."""
    spark = df.sparkSession
    task_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)), task_bytes


def scan_tasks(df: DataFrame) -> int:
    """Tasks for a scan by its bytes alone, four for each core at least, whatever the number of its files."""
    bytes_, task_bytes = _scanned(df)
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // task_bytes))


PLAIN_NODES = {
    "Project", "Filter", "SubqueryAlias", "Union", "Join", "Aggregate", "Generate", "Distinct", "Deduplicate",
    "Repartition", "RepartitionByExpression", "LogicalRelation",
}


def fingerprint(df: DataFrame) -> str:
    """What tells a table from another: the files it is made of and how, or else its rows.

    For plain relational work on files: their names, lengths and times, and the plan. No row
    is read. Tables that hold other data, functions of the caller or other operators are
    read once: number and contents of the rows, whatever their order.
    """
    files = _manifest(df)
    if files is not None:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        return hashlib.sha256("\n".join([df.schema.json(), plan, *files]).encode()).hexdigest()
    high, low = F.xxhash64(*df.columns), F.hash(*df.columns)
    sums = F.sum(high.cast("decimal(38,0)")), F.sum(low.cast("bigint")), F.bit_xor(high)
    return "/".join(str(x) for x in df.agg(F.count(F.lit(1)), *sums).first())


def _manifest(df: DataFrame) -> list[str] | None:
    """Path, length and time of every file, or None where the plan is more than files."""
    plan = df._jdf.queryExecution().analyzed()
    pattern = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    if plan.containsPattern(pattern.PYTHON_UDF()) or plan.containsPattern(pattern.SCALA_UDF()) or not plan.deterministic():
        return None
    files, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in PLAIN_NODES:
            return None
        if node.getClass().getSimpleName() == "LogicalRelation":
            if node.relation().getClass().getSimpleName() != "HadoopFsRelation":
                return None
            index = node.relation().location()
            if index.getClass().getSimpleName() != "InMemoryFileIndex":
                return None
            listed = index.allFiles()
            found = (listed.apply(i) for i in range(listed.size()))
            files += [f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}" for f in found]
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sorted(files)
