"""Names beside the columns of the user."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(name: str, *tables: DataFrame) -> str:
    """The name, or the name with as many `_` behind it as make it differ from all columns."""
    taken = {column.lower() for table in tables for column in table.columns}
    while name.lower() in taken:
        name += "_"
    return name
