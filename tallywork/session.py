"""Session settings and the shared scratch area."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # chained merges on one key set keep their partitioning, which otherwise blocks skew splitting
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # streaming state that outgrows the heap of an executor
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


SCRATCH_SETTING = "tallywork.scratch.dir"


def build_session(app_name: str = "tallywork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` takes dotted names with ``__`` for the dot.

    Cluster sizes (executors, ``spark.sql.shuffle.partitions``) are left to the caller: adaptive
    execution coalesces a generous number of shuffle partitions, but cannot add any.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; :data:`SCRATCH_SETTING` may name another for this
    library alone. Only a master within one process, where every task sees the driver's disk, may fall
    back to a temporary folder, which is then remembered in that setting.
    """
    root = spark.conf.get(SCRATCH_SETTING, None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tallywork-")
    spark.conf.set(SCRATCH_SETTING, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/tallywork/{app}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the scratch area and return the table read back.

    The written table cuts the lineage: later jobs see the same rows even if executors are lost,
    and read only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch area; tables read from it become unusable."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{scratch_root(spark).rstrip('/')}/tallywork/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A job's scratch area: what is written within the block, and is needed no longer, goes at its end.

    Results must be written or shown inside the block. Only the folder of this block is deleted.
    """
    outer = spark.conf.get(SCRATCH_SETTING, None)
    folder = f"{scratch_root(spark).rstrip('/')}/tallywork-{uuid.uuid4().hex}"
    spark.conf.set(SCRATCH_SETTING, folder)
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if outer is None:
            spark.conf.unset(SCRATCH_SETTING)
        else:
            spark.conf.set(SCRATCH_SETTING, outer)
