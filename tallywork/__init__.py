"""Descriptive analytics on Spark: DataFrame in, DataFrame out, column names as parameters."""

from tallywork.session import build_session

__all__ = ["build_session"]
