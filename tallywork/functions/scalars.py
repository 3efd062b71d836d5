"""Number, text, list and JSON functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """A floating NaN becomes NULL, the library's only notion of missing."""
    return F.nanvl(value, F.lit(None))


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def text_slice(text: Column, start: int, length: int) -> Column:
    """``length`` characters from 1-based ``start``; start 0 covers one character before the text."""
    if start == 0:
        return F.substring(text, 1, max(length - 1, 0))
    return F.substring(text, start, length)


def flag_and_text(flag: Column, text: Column) -> Column:
    """A boolean and a text joined by a blank, missing parts spelled ``None``: ``True ASDS``."""
    return F.concat_ws(
        " ",
        F.coalesce(F.initcap(flag.cast("string")), F.lit("None")),
        F.coalesce(text, F.lit("None")),
    )


def list_length(items: Column) -> Column:
    """Number of items; NULL for a missing list."""
    return F.when(items.isNotNull(), F.size(items))


def first_item(items: Column) -> Column:
    """First item; NULL for an empty or missing list."""
    return F.try_element_at(items, F.lit(1))


def json_field(text: Column, path: str, dtype: str = "string") -> Column:
    """One field of a JSON text, NULL where the text or the value does not parse."""
    return F.get_json_object(text, path).try_cast(dtype)


def with_json_fields(df: DataFrame, text: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Several fields of a JSON text, ``{column: (path, type)}``, from one parse of it.

    As :func:`json_field`, NULL where the text or the value does not parse; a text that names a key twice does not.
    """
    parsed = df.withColumn("__json", F.try_parse_json(F.col(text)))
    return parsed.withColumns({
        name: F.try_variant_get("__json", path, dtype) for name, (path, dtype) in fields.items()}).drop("__json")


def fill_constant(value: Column, constant) -> Column:
    return F.coalesce(value, F.lit(constant))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(numerator, denominator)
