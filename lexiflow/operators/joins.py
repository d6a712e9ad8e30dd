"""Joins of a large, possibly skewed table with a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether the table is within both bounds.

    Rows and bytes are summed where they lie; only the sums of each task are moved.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, total = table.agg(F.count("*"), size).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join rows to a lookup table on one key.

    A table measured to be within the bounds is broadcast. Any other is stored, and the
    two sides are shuffled: both exchanges then stand directly under the join, so adaptive
    execution splits the partition of a frequent key wherever its rows come from. The
    rows are read once in either case, by the join itself.
    """
    if fits_broadcast(table, max_rows, max_bytes):
        return rows.join(F.broadcast(table), on, how)
    return rows.join(stage(table, "lookup").hint("merge"), on, how)
