"""What the operators share: page columns, digests of rows and texts, and shipping of task code."""

from __future__ import annotations

import string
import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# task functions travel by value, so that executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

PAGE_ID = "page_id"
HTML = "html"


def text_of(html: str | Column = HTML) -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))


def page_texts(pages: DataFrame, *more: str) -> DataFrame:
    """(page_id, html and the further columns named), missing texts as empty ones.

    Every operator starts from these columns alone, so further columns of any name cannot clash.
    """
    return pages.select(PAGE_ID, text_of().alias(HTML), *more)


def digest_columns(text: str | Column = HTML, prefix: str = "text") -> list[Column]:
    """Two 64-bit hashes with different seeds, together a 128-bit key of the text."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text).alias(f"{prefix}_a"), F.xxhash64(F.lit(prefix), text).alias(f"{prefix}_b")]


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z in lower case and no other letter changed; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where lambdas use it.

    Without it a lambda that refers to a computed array may compute the array for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
