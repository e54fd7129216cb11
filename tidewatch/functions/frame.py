"""Small frame helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate (exactly one row) to every row."""
    return df.join(F.broadcast(one_row))
