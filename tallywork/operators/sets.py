"""Stacking of tables and removal of repeated rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL, repeated rows stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; missing equals missing."""
    return df.distinct()
