"""Grouped and global aggregates, frequency tables and shares.

Every function aggregates partially before its shuffle, so a hot key arrives as one row per task.
With ``dropna`` rows whose keys are missing are left out, without it they form a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.scalars import round_half_even

_FUNCTIONS = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "nunique": F.countDistinct,
}


def _grouped(df: DataFrame, keys: Sequence[str], dropna: bool):
    if dropna and keys:
        df = df.na.drop("any", subset=list(keys))
    return df.groupBy(*keys)


def _key_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_mean(df: DataFrame, keys, value: str, out: str | None = None, dropna: bool = True) -> DataFrame:
    return _grouped(df, _key_list(keys), dropna).agg(F.avg(value).alias(out or value))


def group_count(df: DataFrame, keys, col: str, out: str | None = None, dropna: bool = True) -> DataFrame:
    """Number of non-missing values of ``col``."""
    return _grouped(df, _key_list(keys), dropna).agg(F.count(col).alias(out or col))


def group_sum(df: DataFrame, keys, value: str, out: str | None = None, dropna: bool = True) -> DataFrame:
    """Sums, where a group without any value sums to 0."""
    total = F.coalesce(F.sum(value), F.lit(0))
    return _grouped(df, _key_list(keys), dropna).agg(total.alias(out or value))


def group_rows(df: DataFrame, keys, out: str = "count") -> DataFrame:
    """Rows per group; missing keys are a group of their own."""
    return df.groupBy(*_key_list(keys)).agg(F.count(F.lit(1)).alias(out))


def group_multi(df: DataFrame, keys, functions: Mapping[str, str | Sequence[str]], dropna: bool = True) -> DataFrame:
    """Several aggregates in one pass: ``{column: function or functions}``.

    A single function keeps the column's name, several are named ``column_function``.
    """
    aggregates = []
    for col, wanted in functions.items():
        if isinstance(wanted, str):
            aggregates.append(_FUNCTIONS[wanted](col).alias(col))
        else:
            aggregates += [_FUNCTIONS[f](col).alias(f"{col}_{f}") for f in wanted]
    return _grouped(df, _key_list(keys), dropna).agg(*aggregates)


def partial_sums(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], counted: Sequence[str] = ()
) -> DataFrame:
    """(keys, <value>_sum, <value>_n, <counted>_n): the finest grouping a set of tables needs.

    Means, sums and counts over any subset of the keys follow from it, so a report with many tables
    scans and shuffles its facts once.
    """
    sums = [a for v in values for a in (F.sum(v).alias(f"{v}_sum"), F.count(v).alias(f"{v}_n"))]
    return df.groupBy(*keys).agg(*sums, *[F.count(c).alias(f"{c}_n") for c in counted])


def mean_of_sums(partial: DataFrame, keys, values: str | Sequence[str], dropna: bool = True) -> DataFrame:
    """Means of the original rows from :func:`partial_sums`."""
    means = [F.try_divide(F.sum(f"{v}_sum"), F.sum(f"{v}_n")).alias(v) for v in _key_list(values)]
    return _grouped(partial, _key_list(keys), dropna).agg(*means)


def sum_of_sums(partial: DataFrame, keys, value: str, dropna: bool = True) -> DataFrame:
    total = F.coalesce(F.sum(f"{value}_sum"), F.lit(0))
    return _grouped(partial, _key_list(keys), dropna).agg(total.alias(value))


def count_of_sums(partial: DataFrame, keys, value: str, out: str | None = None, dropna: bool = True) -> DataFrame:
    return _grouped(partial, _key_list(keys), dropna).agg(F.sum(f"{value}_n").alias(out or value))


def total_where(df: DataFrame, conditions: Mapping[str, Column], value: str, empty=None) -> DataFrame:
    """Filtered sums, one output column per named condition, all in one scan.

    ``empty`` is the sum over no value at all (NULL unless given).
    """
    sums = [
        F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(empty)).alias(name)
        for name, cond in conditions.items()
    ]
    return df.agg(*sums)


def mean_where(df: DataFrame, condition: Column, value: str, out: str) -> DataFrame:
    return df.filter(condition).agg(F.avg(value).alias(out))


def first_date_where(df: DataFrame, condition: Column, date: str, out: str) -> DataFrame:
    return df.filter(condition).agg(F.min(date).alias(out))


def success_rate(df: DataFrame, label: str, out: str = "success_rate") -> DataFrame:
    """Mean of a 0/1 label."""
    return df.agg(F.avg(label).alias(out))


def frequencies(df: DataFrame, col: str, out: str = "count", dropna: bool = True) -> DataFrame:
    """Rows per value, in no particular order."""
    if dropna:
        df = df.filter(F.col(col).isNotNull())
    return group_rows(df, [col], out)


def value_counts(df: DataFrame, col: str, out: str = "count", dropna: bool = True) -> DataFrame:
    """Frequency table, most frequent first, ties in the order of the values."""
    return frequencies(df, col, out, dropna).orderBy(F.desc(out), F.asc(col))


def _percent_of_total(grouped: DataFrame, amount: str, out: str, digits: int | None) -> DataFrame:
    # the total comes from the grouped rows, whose shuffle the subquery reuses, not from a second scan
    total = grouped.agg(F.sum(amount)).scalar()
    percent = F.try_divide(F.col(amount), total) * 100
    return grouped.withColumn(out, percent if digits is None else round_half_even(percent, digits))


def value_shares(df: DataFrame, col: str, digits: int | None = 1, out: str = "percent") -> DataFrame:
    """Relative frequencies in percent, most frequent first."""
    return shares_of_counts(frequencies(df, col, "count"), col, digits, out)


def shares_of_counts(counts: DataFrame, col: str, digits: int | None = 1, out: str = "percent") -> DataFrame:
    """The same from a frequency table (``col``, count)."""
    return (_percent_of_total(counts, "count", out, digits)
            .orderBy(F.desc("count"), F.asc(col)).select(col, out))


def share_of_total(df: DataFrame, key: str, value: str, digits: int | None = 1, out: str = "percent") -> DataFrame:
    """Group sums and their percentage of the grand total."""
    return _percent_of_total(group_sum(df, key, value), value, out, digits)


def shares_of_rows(df: DataFrame, value: str, digits: int | None = 1, out: str = "percent") -> DataFrame:
    """Each row's ``value`` as a percentage of the column's sum, for results already grouped."""
    return _percent_of_total(df, value, out, digits)


def ranked_counts_between(df: DataFrame, key: str, date: str, lo, hi, out: str = "count") -> DataFrame:
    """Rows per key within an inclusive date range, most frequent first."""
    kept = df.filter(F.col(date).between(F.lit(lo), F.lit(hi)))
    return group_rows(kept, [key], out).orderBy(F.desc(out), F.asc_nulls_last(key))


def pivot_mean(
    df: DataFrame, row: str, col: str, value: str, levels: Sequence, dropna: bool = True
) -> DataFrame:
    """Cross table of means; given ``levels`` spare the extra job that would look for them."""
    if dropna:
        df = df.na.drop("any", subset=[row, col])
    return df.groupBy(row).pivot(col, list(levels)).agg(F.avg(value))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
