"""Projections: choosing, deriving, renaming, casting and recoding columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.functions.scalars import nan_to_null


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; present: {df.columns}")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` a name that does not exist is an error."""
    require_columns(df, cols)
    return df.drop(*cols)


def derive(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Add or replace one column, given as a Column or a SQL expression."""
    return df.withColumn(name, F.expr(value) if isinstance(value, str) else value)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def snake_case(name: str) -> str:
    text = name.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_column_names(df: DataFrame) -> DataFrame:
    """Snake case; a repeated name gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns; numbers are truncated toward zero. Unless ``strict``, bad values become NULL."""
    require_columns(df, types)
    cast = {c: (F.col(c).cast(t) if strict else F.col(c).try_cast(t)) for c, t in types.items()}
    return df.withColumns(cast)


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None, default=None) -> DataFrame:
    """Replace values by a fixed dictionary; a value outside it becomes ``default`` (NULL if none).

    The dictionary is code, hence small, and is evaluated inside the projection. Mappings that are
    data belong in a table and :func:`tallywork.operators.joins.enrich`.
    """
    chain = F
    for key, value in mapping.items():
        chain = chain.when(F.col(col) == F.lit(key), F.lit(value))
    recoded = F.lit(default) if chain is F else chain.otherwise(F.lit(default))
    return df.withColumn(out or col, recoded)


def label_membership(df: DataFrame, col: str, bad_values: Sequence, out: str) -> DataFrame:
    """0 if the value is in ``bad_values``, otherwise (missing values too) 1."""
    label = F.when(F.col(col).isin(list(bad_values)), F.lit(0)).otherwise(F.lit(1))
    return df.withColumn(out, label)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; meant to follow each read."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if floating else df
