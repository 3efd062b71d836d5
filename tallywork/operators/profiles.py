"""Profiles of a table: missing values, distinct values, duplicates, summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators.quantiles import QUARTILES, column_quantiles, quantiles, widen
from tallywork.operators.sets import union_all


def _long(row: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """A one-row aggregate with a column per input column, turned into (column, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(value)) for c in cols])
    return row.select(F.inline(pairs))


def _missing(col: str) -> Column:
    return F.sum(F.col(col).isNull().cast("long"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), one pass over the table."""
    counts = df.agg(*[F.coalesce(_missing(c), F.lit(0)).alias(c) for c in df.columns])
    return _long(counts, df.columns, "nulls")


def null_percent(df: DataFrame) -> DataFrame:
    """(column, percent) of rows where the column is missing."""
    rows = F.count(F.lit(1))
    shares = df.agg(*[(F.try_divide(_missing(c), rows) * 100).alias(c) for c in df.columns])
    return _long(shares, df.columns, "percent")


def _exact_key(kind: T.DataType, col: str) -> tuple[Column | None, Column | None, Column | None] | None:
    """A simple value as one of (whole number, number, text), different for different values; None for nested types."""
    value = F.col(col)
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return value.cast("long"), None, None
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long"), None, None
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value), None, None
    if isinstance(kind, T.FloatType | T.DoubleType):
        return None, value.cast("double"), None
    if isinstance(kind, T.BinaryType):
        return None, None, F.hex(value)
    if isinstance(kind, T.StringType | T.DecimalType | T.TimestampNTZType):
        return None, None, value.cast("string")
    return None


def distinct_counts(
    df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, chunk: int = 1, one_scan: bool = False
) -> DataFrame:
    """(column, distinct), missing values not counted; zeros for an empty table.

    Several exact distinct counts in one aggregate repeat each row once per column. A plain columnar table is better read
    column by column, which ``chunk=1`` does, or few columns at a time.

    With ``one_scan`` all columns of simple types are counted together from one pass and one shuffle, the way for rows that
    come from a costly join or from text files: (column number, value) are grouped, whole numbers, dates and timestamps as
    runs of 64 with a bitmap of those found, so that dense ids take a 64th of the rows and scattered ones a row each. Text
    is compared by its bytes; NaN is one value, and so are 0.0 and -0.0. Nested values go column by column all the same.

    ``approx`` needs one pass and no repetition.
    """
    cols = list(cols or df.columns)
    if approx:
        return _long(df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]), cols, "distinct")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = {c: k for c in cols if (k := _exact_key(kinds[c], c)) is not None} if one_scan else {}
    parts = [_distinct_in_one_scan(df, keys)] if keys else []
    rest = [c for c in cols if c not in keys]
    for at in range(0, len(rest), chunk):
        some = rest[at:at + chunk]
        parts.append(_long(df.agg(*[F.countDistinct(c).alias(c) for c in some]), some, "distinct"))
    return union_all(parts)


def _distinct_in_one_scan(df: DataFrame, keys: dict[str, tuple[Column | None, Column | None, Column | None]]) -> DataFrame:
    entries = []
    for no, (whole, number, text) in enumerate(keys.values()):
        run, bit = (F.lit(None), F.lit(1)) if whole is None else (
            F.shiftright(whole, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(whole, F.lit(64)).cast("int")))
        given = [k for k in (whole, number, text) if k is not None][0].isNotNull()
        entries.append(F.when(given, F.struct(
            F.lit(no).alias("no"), run.cast("long").alias("run"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
            (F.lit(None) if text is None else text).cast("string").alias("text"), bit.cast("long").alias("bit"))))
    values = df.select(F.inline(F.array(*entries))).filter(F.col("no").isNotNull())
    runs = values.groupBy("no", "run", "number", "text").agg(F.bit_or("bit").alias("bits"))
    counts = runs.groupBy("no").agg(F.sum(F.bit_count("bits").cast("long")).alias("distinct"))
    # a column without values has no row there
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("no", "distinct"))).alias("found"))
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.try_element_at("found", F.lit(no)), F.lit(0)).alias("distinct"))
        for no, c in enumerate(keys)])))


def n_distinct(df: DataFrame, col: str, out: str = "n_distinct") -> DataFrame:
    """Distinct values of one column, where missing counts as a value."""
    missing = F.coalesce(F.max(F.col(col).isNull().cast("long")), F.lit(0))
    return df.agg((F.countDistinct(col) + missing).alias(out))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None, out: str = "duplicates") -> DataFrame:
    """Rows after the first of each set of equal rows (in ``cols``); missing equals missing."""
    groups = df.groupBy(*(cols or df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias(out))


def _column_quantiles(numbers: DataFrame, cols: Sequence[str], approx: bool) -> DataFrame:
    """(no, prob, quantile) of each column by its number."""
    if approx:
        parts = [quantiles(numbers.select(F.lit(i).alias("no"), F.col(c).alias("value")), "value",
                           QUARTILES, ["no"], approx=True) for i, c in enumerate(cols)]
        return union_all(parts)
    return column_quantiles(numbers, cols, QUARTILES)


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numeric columns.

    The quartiles are exact and interpolated unless ``approx``.
    """
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    summary = numbers.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).alias("min"), F.max(c).alias("max")).alias(c)
        for c in cols
    ])
    summary = _long(summary, cols, "s").select("column", "s.*")
    names = dict(zip(QUARTILES, ("q25", "q50", "q75"), strict=True))
    spread = widen(_column_quantiles(numbers, cols, approx), ["no"], names)
    column = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("no") + 1)
    spread = spread.select(column.alias("column"), *names.values())
    order = ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return summary.join(spread, "column", "left").select(*order)


def table_profile(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null, rows, columns), the shape and content at a glance."""
    types = dict(df.dtypes)
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                 F.col(c).alias("non_null"), F.col("__rows").alias("rows"),
                 F.lit(len(df.columns)).alias("columns"))
        for i, c in enumerate(df.columns)
    ])
    return counted.select(F.inline(fields))
