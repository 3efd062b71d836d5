"""Sorting, first and last rows, and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.operators.aggregates import frequencies
from tallywork.operators.numbering import renumber

Order = Sequence[str | Column]


def sort(df: DataFrame, cols: str | Sequence[str], descending: bool = False) -> DataFrame:
    """Global sort with missing values last in either direction.

    Ties are ordered by a hash of the row's content: the order is the same in every run, and the rows of a much
    repeated value can be dealt out to several tasks. Only rows that are equal throughout stay together.
    """
    names = [cols] if isinstance(cols, str) else cols
    key = F.desc_nulls_last if descending else F.asc_nulls_last
    return df.orderBy(*[key(c) for c in names], _content(df))


def _content(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def level_position(col: str, levels: Sequence[str]) -> Column:
    """1-based position in a fixed order of levels; values outside it come last, as NULL."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), F.col(col))
    return F.nullif(position, F.lit(0)).cast("int")


def sort_by_levels(df: DataFrame, col: str, levels: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Sort by a custom order of values, kept as the column ``<col>_order``; ties as in :func:`sort`."""
    ordered = df.withColumn(f"{col}_order", level_position(col, levels))
    return ordered.orderBy(F.asc_nulls_last(f"{col}_order"), *then, _content(df))


def _sort_columns(order: Order) -> list[Column]:
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]


def head(df: DataFrame, n: int, order: Order, rank: str | None = None) -> DataFrame:
    """First ``n`` rows in ``order``, optionally with their 1-based rank.

    Every task keeps only its own best ``n`` before the final merge, and the rank is drawn on
    those ``n`` rows.
    """
    best = df.orderBy(*_sort_columns(order)).limit(n)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*_sort_columns(order))))


def _reversed(order: Order) -> list[Column]:
    return [F.desc_nulls_first(c) for c in order]


def tail(df: DataFrame, n: int, order: Sequence[str], rank: str | None = None) -> DataFrame:
    """Last ``n`` rows in ``order``, shown in that order; nothing passes through the driver."""
    return head(df.orderBy(*_reversed(order)).limit(n), n, order, rank)


def rank_by_count(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Every value with its frequency and 0-based position in descending frequency, ties by value."""
    return renumber(frequencies(df, col), [F.desc("count"), F.asc(col)], out, start=0, unique=True)


def values_at_ranks(df: DataFrame, col: str, ranks: Sequence[int], rank: str = "rank") -> DataFrame:
    """The values at given 0-based positions of :func:`rank_by_count`.

    Only the first ``max(ranks) + 1`` values are kept, so this stays cheap for any number of them.
    """
    order = [F.desc("count"), F.asc(col)]
    top = head(frequencies(df, col), max(ranks) + 1, order, rank)
    return top.withColumn(rank, F.col(rank) - 1).filter(F.col(rank).isin(list(ranks))).select(rank, col)
