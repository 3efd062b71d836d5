"""Global positions over any number of rows.

A window without partition keys would pull the whole table into one task. Here the rows are
range-partitioned by the order, sorted where they are, and written once with the number of their
partition and their place in it; the partition sizes then give each partition's first number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywork.session import write_scratch

PART = "__part"
PLACE = "__place"
_PLACE_BITS = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def store_in_order(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """``df`` range-partitioned and sorted, written with PART and PLACE columns.

    The partition bounds come from sampling, so they hold for one run only; writing the outcome
    makes PART and PLACE facts that later jobs, and retried tasks, agree on.
    """
    sort = [F.asc(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumns({
            PART: F.spark_partition_id(),
            PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)),
        })
    )
    return write_scratch(placed, label)


def renumber(
    df: DataFrame, order: Sequence[str | Column], out: str = "row_number", start: int = 1, unique: bool = False
) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... in ``order``.

    Ties are ordered by the hash of the row's content: the numbers are the same in every run, and
    the rows of a much repeated order value need not share one partition. Say ``unique`` if there
    are no ties, to save the hash. Runs one job, which writes the ordered rows to the scratch area.
    """
    if not unique:
        content = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        order = [*order, F.xxhash64(*content)]
    placed = store_in_order(df, order, "renumber")
    parts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(  # one row per partition of the written table
        F.col(PART), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    )
    numbered = placed.join(F.broadcast(offsets), PART)
    position = F.col("__before") + F.col(PLACE) + F.lit(start)
    kept = [c for c in df.columns if c != out]
    return numbered.select(*kept, position.alias(out))
