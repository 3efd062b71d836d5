"""One JSON array in a file, read by many tasks.

The text source splits a file by bytes if records end in a given text; here they end in "}". What lies between two such
ends says how the nesting changes and whether it opens or closes a string, for either of the two states in which it may
begin. These changes, summed up for each split, tell in which state every split begins, and then each task finds the ends
of records, closing braces outside of strings that lead back into the array, in its own split alone. Only a record that
reaches over the end of its split is put together from pieces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.session import write_scratch

# executors get this module's functions with the task and need no copy of the package
register_pickle_by_value(sys.modules[__name__])

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_STEP = np.zeros(256, "int8")
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
#: Splits whose states are sent to all tasks; a row for each 128 MB or so of input.
MOST_SPLITS = 1 << 21
SPLIT = ["path", "start"]


def _scan(fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments that end in "}": their ends, and up to each end the number of quotes and the change of depth by brackets
    after an even and after an odd number of quotes."""
    raw = np.frombuffer(b"}".join(fragments) + b"}", "uint8")
    ends = np.cumsum([len(f) + 1 for f in fragments])
    quote = raw == _QUOTE
    if (raw == _ESCAPE).any():  # an odd number of backslashes before a quote makes it a character
        slash = raw == _ESCAPE
        place = np.arange(raw.size)
        last_other = np.maximum.accumulate(np.where(slash, -1, place))
        run = place - last_other  # backslashes up to here
        before = np.concatenate([[0], run[:-1]])
        quote &= before % 2 == 0
    quotes = np.cumsum(quote)
    step, odd = _STEP[raw].astype("int64"), quotes % 2 == 1
    return ends, quotes[ends - 1], np.cumsum(np.where(odd, 0, step))[ends - 1], np.cumsum(np.where(odd, step, 0))[ends - 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut so that each piece lies in one split, with the values of its other columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(x, y - x)
            yield tuple(c[0].as_py() for c in piece.columns[1:]), piece


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, quotes, even, odd): the sums of a split, a row for each run of it."""
    for (path, start), piece in _runs(batches):
        _, quotes, even, odd = _scan(piece.column(0).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "quotes": [int(quotes[-1])], "even": [int(even[-1])], "odd": [int(odd[-1])]})


def _states(table: pd.DataFrame) -> pd.DataFrame:
    """(path, start, inside, depth) of a file's splits, in order, from the runs' sums, which ``no`` orders within a split."""
    inside, depth, out = 0, 0, []
    for (path, start), runs in table.sort_values(["start", "no"]).groupby(SPLIT, sort=False):
        out.append((path, start, inside, depth))
        for quotes, even, odd in zip(runs["quotes"], runs["even"], runs["odd"], strict=True):
            depth += odd if inside else even  # begun in a string, what comes after an odd number of quotes is outside
            inside = (inside + quotes) % 2
    return pd.DataFrame(out, columns=["path", "start", "inside", "depth"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, kind, no, text) with kind "whole", or "head" and "tail" for what a split has of records that leave it."""
    held: list[bytes] = []
    at, inside, depth, no, ended = None, 0, 0, 0, False

    def row(kind: str, text: bytes, number: int) -> tuple:
        return (*at, kind, number, text.decode("utf-8", "replace"))

    def left() -> list[tuple]:
        # an empty tail says that the next split begins with a record of its own
        return [row("tail" if ended else "middle", b"".join(held), no)]

    for (path, start, begins_inside, begins_depth), piece in _runs(batches):
        out: list[tuple] = []
        if (path, start) != at:
            if at is not None:
                out += left()
            held, at, inside, depth, no, ended = [], (path, start), begins_inside, begins_depth, 0, False
        fragments = piece.column(0).cast(pa.binary()).to_pylist()
        _, quotes, even, odd = _scan(fragments)
        within = (inside + quotes) % 2 == 1
        deep = depth + (odd if inside else even)
        last = 0
        for i in np.flatnonzero(~within & (deep == 1)).tolist():
            text = b"".join(held) + b"}".join(fragments[last:i + 1]) + b"}"
            out.append(row("whole" if ended or start == 0 else "head", text, no))
            held, last, no, ended = [], i + 1, no + 1, True
        if last < len(fragments):
            held.append(b"}".join(fragments[last:]) + b"}")
        inside, depth = int((inside + quotes[-1]) % 2), int(deep[-1])
        if out:
            yield _rows(out)
    if at is not None:
        yield _rows(left())


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)],
        ["path", "start", "kind", "no", "text"])


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text) of each object in files that hold one JSON array of objects each, by tasks that read parts of a file.

    Objects may hold anything, nested arrays and objects, braces and quotes in strings included. A file without an object
    gives no rows. What follows the last object, other than the array's end, is a row of its own, as is a file without an array.
    Two passes over the files, and a row for each split that the tasks are told.
    """
    lines = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    sums = lines.mapInArrow(_changes, "path string, start long, quotes long, even long, odd long").withColumn(
        "no", F.monotonically_increasing_id())  # runs of a split come from one task, in order
    states = write_scratch(write_scratch(sums, "json_sums").groupBy("path").applyInPandas(
        _states, "path string, start long, inside int, depth long"), "json_states")  # a file's splits
    if states.count() > MOST_SPLITS:
        raise ValueError("too many splits for their states to be sent: raise spark.sql.files.maxPartitionBytes, or read fewer files at once")
    known = states.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"), "inside", "depth")
    told = lines.join(F.broadcast(known), (F.col("path") == F.col("s_path")) & (F.col("start") == F.col("s_start")), "left").select(
        "value", "path", "start",
        # the second pass must see the splits of the first
        F.coalesce("inside", F.raise_error(F.lit("the files are split in another way than before")).cast("int")).alias("inside"), "depth")
    pieces = write_scratch(told.mapInArrow(_records, "path string, start long, kind string, no long, text string"), "json_records")
    parts = pieces.filter("kind <> 'whole'")
    order = Window.partitionBy("path").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)  # two rows a split at most
    spanning = parts.withColumn("record", F.coalesce(F.last(F.when(F.col("kind") == "tail", F.col("start")), ignorenulls=True).over(order), F.lit(-1)))
    spanning = spanning.withColumn("record", F.when(F.col("kind") == "tail", F.col("start")).otherwise(F.col("record")))
    joined = spanning.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "no", "text"))).alias("p")).select(
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    every = pieces.filter("kind = 'whole'").select("text").unionByName(joined)
    bare = F.regexp_replace("text", r"^[\s,\[]+", "")
    return every.select(bare.alias("text")).filter(~F.col("text").rlike(r"^[\s\]}]*$"))
