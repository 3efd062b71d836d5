"""Event monitoring as streams.

Each function takes a streaming DataFrame and returns one; late rows beyond the watermark are
dropped, and windows come out once they can no longer change (append mode). State is bounded by the
watermark: per window a row per key, per deduplicated id one entry.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywork.session import scratch_path

# executors get this module's functions with the task and need no copy of the package
register_pickle_by_value(sys.modules[__name__])


def read_event_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
    pattern: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream, optionally only those whose names match ``pattern``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Declare the event time and how late events may come; zone-free times become zoned."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicate(stream: DataFrame, event_id: str, ts: str, delay: str) -> DataFrame:
    """Drop repeated ids that arrive within ``delay`` of each other."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark([event_id])


def tumbling_counts(stream: DataFrame, ts: str, kind: str, width: str, delay: str) -> DataFrame:
    """(window_start, window_end, kind, count) of fixed, adjacent windows."""
    counts = with_event_time(stream, ts, delay).groupBy(F.window(ts, width), kind).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "count")


def sliding_suspects(
    stream: DataFrame, ts: str, account: str, source: str, width: str, slide: str, delay: str,
    min_attempts: int, min_sources: int,
) -> DataFrame:
    """Accounts with many attempts from many sources within one sliding window.

    Streams refuse distinct counts. Attempts are counted per window, account and source first, and these counts
    per window and account then, so that the number of sources is exact; a missing source isn't counted as one.
    State is a row for each source of an account and window until the watermark has passed it.
    """
    window = F.window(ts, width, slide).alias("window")
    per_source = with_event_time(stream, ts, delay).groupBy(window, account, source).agg(F.count(F.lit(1)).alias("n"))
    counts = per_source.groupBy("window", account).agg(F.sum("n").alias("attempts"), F.count(source).alias("sources"))
    suspects = counts.filter((F.col("attempts") >= min_attempts) & (F.col("sources") >= min_sources))
    return suspects.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        account, "attempts", "sources")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bucket) rows to (key, bucket, count): one row for each key and bucket of an Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            counts = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([([], "count_all")])
            yield from counts.select([*batch.schema.names, "count_all"]).rename_columns(
                [*batch.schema.names, "count"]).combine_chunks().to_batches()


def _against_history(width_us: int, k: float, min_history: int, forget_after: int, names: list[str]):
    """Compares each closed bucket of a key with those before it, of which the state keeps number, sum and sum of squares.

    State also holds the counts of the buckets that are still open; a timeout at the end of the first of them closes it once the
    watermark is there. A bucket without events counts as 0: when the next one closes, the times say how many there were. A key
    without open buckets waits for the timeout that forgets it; should it come back after a longer silence but before
    that has run, the gap itself says so.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, total, squares, ends, counts = state.get if state.exists else (None, None, 0, 0.0, [], [])
        is_open = dict(zip(ends or [], counts or [], strict=True))
        for part in parts:
            for bucket, count in zip(part["__bucket_us"].tolist(), part["count"].tolist(), strict=True):
                is_open[bucket] = is_open.get(bucket, 0) + count
        watermark_us = state.getCurrentWatermarkMs() * 1000
        out = []
        for bucket in sorted(b for b in is_open if b + width_us <= watermark_us):
            count = is_open.pop(bucket)
            if first is None or (bucket - last) // width_us > forget_after:
                first, total, squares = bucket, 0, 0.0
            n = (bucket - first) // width_us
            if n >= max(min_history, 1):
                mean = total / n
                deviation = max(squares / n - mean * mean, 0.0) ** 0.5
                if deviation > 0 and (count - mean) / deviation > k:
                    out.append((*key, bucket, count, mean, deviation, (count - mean) / deviation))
            last, total, squares = bucket, total + count, squares + float(count) * count
        wake_us = min(is_open) + width_us if is_open else last + (forget_after + 2) * width_us
        if not is_open and wake_us <= watermark_us:
            state.remove()
        else:
            waiting = sorted(is_open)
            state.update((first, last, total, squares, waiting, [is_open[b] for b in waiting]))
            state.setTimeoutTimestamp(-(-wake_us // 1000))
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def spikes(
    stream: DataFrame, ts: str, key: str, width: str, delay: str, k: float = 3.0, min_history: int = 24, forget_after: int = 24 * 30
) -> DataFrame:
    """(key, bucket, count, mean, deviation, z): buckets of time whose count lies more than ``k`` deviations above the key's mean.

    The stream form of ``plans.network.traffic_spikes``. A stream knows no bucket to come, so mean and deviation are
    those of the key's buckets before, from its first one on, those without an event as 0; a key is judged once it has
    ``min_history`` of them, and anew after a silence of ``forget_after`` buckets or more. A key with a constant rate has no
    deviation and no spike. A bucket closes, and comes out, ``delay`` before the end of the latest bucket that has begun; rows of
    a closed bucket are dropped. Rows without a time are left out, a missing key is a key.

    Each task counts its events by key and bucket first, so that the keyed state gets some rows for each bucket, however busy its
    key. State is a few numbers a key and those of its open buckets; timeouts in event time close buckets and forget silent keys.
    """
    width_us = int(pd.Timedelta(width).total_seconds() * 1_000_000)
    kind = next(f for f in stream.schema.fields if f.name == key)
    window = F.window(F.col(ts).cast("timestamp"), width)
    placed = stream.filter(F.col(ts).isNotNull()).select(key, window.alias("__w")).select(
        key, F.unix_micros("__w.start").alias("__bucket_us"))
    counted = T.StructType([kind, *T.StructType.fromDDL("__bucket_us long, count long").fields])
    counts = placed.mapInArrow(_counted, counted).withColumn(
        "__end", F.timestamp_micros(F.col("__bucket_us") + width_us)).withWatermark("__end", delay)
    schema = T.StructType([kind, *T.StructType.fromDDL("__bucket_us long, count long, mean double, deviation double, z double").fields])
    found = counts.groupBy(key).applyInPandasWithState(
        _against_history(width_us, k, min_history, forget_after, schema.names), schema,
        "first_us long, last_us long, total long, squares double, open_us array<long>, open_counts array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("__bucket_us").alias("bucket"), "count", "mean", "deviation", "z")


def run_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process all that is there, then stop; the output table is read back from the scratch area.

    With the ``path`` of a run before it goes on from that run's checkpoint, and the table holds the rows of both.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def keep_running(stream: DataFrame, path: str, checkpoint: str, every: str = "1 minute"):
    """Start an endless query into Parquet; both paths must be on shared storage."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(processingTime=every).start()
    )
