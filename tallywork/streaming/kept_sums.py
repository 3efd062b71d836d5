"""Sums that are kept on storage and brought up to date by what arrives, each arrival counted once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ARRIVAL = "arrival"


def store_arrival(sums: DataFrame, folder: str, arrival: int) -> None:
    """Write the sums of one arrival under its number; the same number again takes the place of the first.

    A job that is lost midway leaves its arrival incomplete until it is repeated, which a restarted stream does
    before anything else.
    """
    sums.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{ARRIVAL}={arrival}")


def stored_sums(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The sums over all arrivals, with the columns of each: ``keys``, and the others added up.

    Sums and counts of :func:`partial_sums` may be added; a sum without any value in any arrival stays missing.
    The rows read are those of the groupings, so an update of a report doesn't read the earlier facts again.
    """
    stored = spark.read.parquet(folder).drop(ARRIVAL)
    added = [c for c in stored.columns if c not in keys]
    return stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added])


def keep_sums(
    stream: DataFrame, sums: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str
) -> StreamingQuery:
    """Take what a stream has waiting and store the sums of each of its batches.

    A batch that is repeated after a failure has the same number and the same rows, so it is counted once. One folder
    belongs to one checkpoint. The stream ends when nothing waits; the next call goes on from there.
    """
    def add(batch: DataFrame, number: int) -> None:
        store_arrival(sums(batch), folder, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
