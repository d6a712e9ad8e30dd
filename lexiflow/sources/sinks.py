"""Writers: tables, reports, resumable stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.text import on_one_line
from lexiflow.session import shuffles_removed

# What Spark escapes in the names of partition folders.
UNSAFE = frozenset('"#%\'*/:=?\\\x7f{[]^')


def save_if(df: DataFrame, path: str | None) -> DataFrame:
    """Save when a path is given; the saved table replaces the lineage."""
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_as_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """An external named table."""
    df.write.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def report_lines(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One tab-separated line per row; tabs inside values become one space."""
    cells = [
        F.coalesce(on_one_line(F.col(name).cast("string")), F.lit(""))
        for name in columns or df.columns
    ]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def save_report(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = False
) -> None:
    """A distributed report: one text file per task, each with the header if asked for."""
    names = list(columns or df.columns)
    if not header:
        report_lines(df, names).write.text(path)
        return
    cells = [
        F.coalesce(on_one_line(F.col(name).cast("string")), F.lit("")).alias(name)
        for name in names
    ]
    df.select(*cells).write.csv(
        path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def save_files(texts: DataFrame, path: str, folder: str) -> None:
    """A tree with one file for each row, in subfolders named by a column.

    Tasks write their files themselves in stores that Arrow reaches: Spark's writer makes and renames
    every file through a committer, and sets its mode, which takes a process of its own on a local disk.
    Elsewhere every task puts its own files in their place (the committer's second algorithm); the first
    would have the driver rename them all, one by one.
    """
    try:
        store, root = FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        own = texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        own.partitionBy(folder).text(path)
        return
    value = next(name for name in texts.columns if name != folder)
    store.create_dir(root)
    rows = texts.select(F.col(value).cast("string"), F.col(folder).cast("string"))
    rows.mapInArrow(_file_writer(path, folder), "files long").write.format("noop").mode("append").save()
    with store.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _file_writer(path: str, folder: str):
    """(text, name of its folder) -> a file of each, as Spark's text writer lays and names them; another attempt of a task writes the same names."""

    def named(name: str | None) -> str:
        if not name:
            return f"{folder}=__HIVE_DEFAULT_PARTITION__"
        return f"{folder}=" + "".join(f"%{ord(c):02X}" if c in UNSAFE or ord(c) < 32 else c for c in name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(path)
        part, count, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist()):
                place = f"{root}/{named(name)}"
                if place not in made:
                    store.create_dir(place)
                    made.add(place)
                with store.open_output_stream(f"{place}/part-{part:05d}-{count:08d}.txt") as out:
                    if text.is_valid:
                        out.write(text.as_buffer())
                    out.write(b"\n")
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["files"])

    return write


def is_complete(spark: SparkSession, path: str) -> bool:
    """Only a folder whose write was committed counts as saved."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    log: Callable[[str, str], None] = lambda action, path: None,
) -> DataFrame:
    """Read the stage if it was saved, else build and save it; then read it back."""
    if is_complete(spark, path):
        log("read", path)
        return spark.read.parquet(path)
    log("built", path)
    built = build()
    with shuffles_removed(spark):
        built.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(built.schema).parquet(path)
