"""Row filters. Each is a plain predicate, so the Parquet reader can take it over."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.scalars import list_length

_COMPARE = {
    ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
    "==": operator.eq, "!=": operator.ne,
}


def filter_compare(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """Compare with a constant; NULL rows are dropped, also for ``!=``."""
    return df.filter(_COMPARE[op](F.col(col), F.lit(value)))


def filter_between(df: DataFrame, col: str, lo=None, hi=None, inclusive: bool = True) -> DataFrame:
    """Range filter; leave a bound out for a half-open range."""
    low, high = (">=", "<=") if inclusive else (">", "<")
    if lo is not None:
        df = filter_compare(df, col, low, lo)
    if hi is not None:
        df = filter_compare(df, col, high, hi)
    return df


def prefix_matches(text: Column, prefix: str, ignore_case: bool = True) -> Column:
    """Whether ``text`` starts with ``prefix``; a plain ``startswith`` is pushed to the scan."""
    if ignore_case:
        return F.lower(text).startswith(prefix.lower())
    return text.startswith(prefix)


def filter_prefix(df: DataFrame, col: str, prefix: str, ignore_case: bool = True) -> DataFrame:
    return df.filter(prefix_matches(F.col(col), prefix, ignore_case))


def filter_equals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows where every named column equals its value."""
    for col, value in values.items():
        df = df.filter(F.col(col) == F.lit(value))
    return df


def filter_not_equal_keep_null(df: DataFrame, col: str, value) -> DataFrame:
    """Rows that differ from ``value``, missing values included."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in any column (or any of ``cols``)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def filter_array_size(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose list holds exactly ``n`` items; missing lists are dropped."""
    return df.filter(list_length(F.col(col)) == n)
