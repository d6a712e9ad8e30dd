"""Article metadata from XML files."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import patterns as P
from lexiflow.session import scan_tasks


def scan_xml(spark: SparkSession, root: str, name_pattern: str) -> DataFrame:
    """Whole files under a directory tree whose name matches -> (file_name, path, x).

    A scan plans a few small files to a task, as each counts as megabytes; here a task reads as many
    as its bytes allow, or as the cores leave it.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return files.coalesce(scan_tasks(files)).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("x"),
    ).where(F.col("file_name").rlike(name_pattern))


def dedupe_by_name(files: DataFrame) -> DataFrame:
    """One file per name: the first by path.

    Only names and paths are compared; contents follow through the unique path.
    """
    first = files.groupBy("file_name").agg(F.min("path").alias("path"))
    return files.join(first, ["file_name", "path"], "left_semi")


def _read_fields(x: str, what: Sequence[str]) -> tuple[str, ...] | None:
    """The wanted fields of one document, or None when it cannot be read."""
    try:
        root = ElementTree.fromstring(x)
    except ElementTree.ParseError:
        return None
    texts: dict[str, list[str]] = defaultdict(list)
    for node in root.iter():
        if isinstance(node.tag, str):
            text = "".join(node.itertext())
            texts[node.tag].append(text)
            texts[node.tag.rpartition("}")[2]].append(text)

    def one(name: str, separator: str = "") -> str:
        prefix, local = P.XML_FIELDS[name].split(":")
        return separator.join(texts[f"{{{P.XML_NAMESPACES[prefix]}}}{local}"])

    values = []
    for name in what:
        if name == "PII":
            if not texts["pii"]:
                return None
            values.append(re.sub("[^a-zA-Z0-9]", "", texts["pii"][0]))
        elif name == "Pages":
            values.append(f"{one('FirstPage')}-{one('LastPage')}")
        else:
            values.append(one(name, " " if name == "Authors" else ""))
    return tuple(values)


def extract_xml_fields(
    files: DataFrame, what: Sequence[str] = P.XML_DEFAULT_FIELDS
) -> DataFrame:
    """Pick metadata fields of each (file_name, x); unreadable documents are skipped.

    Fields are named by namespace and local name at any depth, which the XPath
    functions of Spark cannot do (they see no namespaces, parse the document once per
    field, and abort on a malformed one). So each Arrow batch is parsed in Python, one
    parse per document. Several nodes of a field are concatenated, authors with a
    space. The id is the first `pii` of any namespace; when it is asked for, a document
    without one is skipped.
    """
    unknown = set(what) - set(P.XML_FIELDS) - {"PII", "Pages"}
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    names = tuple(what)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (file_name, *fields)
                for file_name, x in zip(batch["file_name"], batch["x"])
                if x is not None and (fields := _read_fields(x, names)) is not None
            ]
            yield pd.DataFrame(found, columns=["file_name", *names])

    schema = ", ".join(f"{name} string" for name in ("file_name", *names))
    return files.select("file_name", "x").mapInPandas(read, schema)
