"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """The given tables as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function from :class:`Tables` to a DataFrame, with the inventory ids it covers."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns (all of type double unless named), as sums depend on their order."""
    chosen = cols or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in chosen})


def longs(df: DataFrame) -> DataFrame:
    """All integers as 64 bit, the one integer type both engines agree on."""
    small = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int")]
    return df.withColumns({c: F.col(c).cast("long") for c in small}) if small else df
