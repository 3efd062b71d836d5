"""CSV, JSON and Parquet files, and named tables."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators.columns import nulls_for_nans
from tallywork.operators.numbering import renumber
from tallywork.operators.sets import union_all
from tallywork.sources.json_arrays import array_records

# executors get this module's functions with the task and need no copy of the package
register_pickle_by_value(sys.modules[__name__])


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType | None = None,
    fmt: str = "csv",
    **options,
) -> DataFrame:
    """Read one table, NaN turned into NULL.

    Without ``schema`` the types of a CSV are inferred, which costs one more pass over the files. With it
    the columns of a CSV are bound by the names in its header, in whatever order the file has them, and
    the others aren't parsed; see :func:`read_csv`.
    """
    if fmt == "csv" and schema is not None:
        return read_csv(spark, [path] if isinstance(path, str) else list(path), schema, **options)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return nulls_for_nans(reader.format(fmt).load(path if isinstance(path, str) else list(path)))


def _first_lines(large: int):
    """Rows (value, path, start, length) of a task's files to the first line of each file that starts here.

    A split of ``large`` bytes or more is alone in its task and is left after its first batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start, length = batch.column(1), batch.column(2), batch.column(3)
            changed = pc.or_(pc.invert(pc.equal(path.slice(1), path.slice(0, batch.num_rows - 1))), False)
            first = pa.concat_arrays([pa.array([path[0].as_py() != seen]), changed])
            yield batch.filter(pc.and_(first, pc.equal(start, 0))).select([0, 1])
            seen = path[batch.num_rows - 1].as_py()
            if length[0].as_py() >= large:
                return

    return run


def headers_of_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """The different first lines of all files below ``paths``, each with the files that have it, in one job.

    Of a large file only the first lines of each split are read. The driver gets the names of the files, which it
    lists for any scan.
    """
    rows = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"))
    large = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    lines = rows.mapInArrow(_first_lines(int(large)), "value string, path string")
    found = lines.groupBy("value").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return sorted((r["value"], [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in r["paths"]]) for r in found)


def _columns_of(spark: SparkSession, line: str, path: str, options: dict) -> tuple[str, ...]:
    """The column names in a header; with options that concern the format the CSV source itself says them."""
    if set(options) <= {"sep", "delimiter"}:
        (names,) = csv.reader([line.removeprefix("\ufeff")], delimiter=options.get("sep", options.get("delimiter", ",")))
        if all(names) and len({n.lower() for n in names}) == len(names):
            return tuple(names)
    return tuple(spark.read.options(**options).option("header", True).csv(path).columns)


def read_csv(
    spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, malformed: str = "fail", **options
) -> DataFrame:
    """The columns of ``schema`` from CSV files or folders with a header, bound by name.

    A column that a header doesn't have is an error. Files whose headers differ, also within a folder, are read apart and
    stacked by name; those that agree are one scan. The headers of all files are found in one job
    (:func:`headers_of_files`), so that the number of jobs follows that of different headers, not of files. Files
    without a line hold no rows. ``malformed`` says what becomes of a record whose cells don't fit their types: "fail" stops the
    read, "null" makes the cells NULL, any other word names a column that receives the record's text.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f for f in wanted.fields}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for line, files in headers_of_files(spark, paths):
        header = _columns_of(spark, line, files[0], options)
        absent = [name for name in types if name not in header]
        if absent:
            raise ValueError(f"{files[0]} has no column {', '.join(absent)}; its header is {', '.join(header)}")
        by_header.setdefault(header, []).extend(files)
    if not by_header:
        empty = T.StructType([*types.values(), *([] if malformed in ("fail", "null") else [T.StructField(malformed, T.StringType())])])
        return spark.createDataFrame([], empty)
    reader = spark.read.options(**options).option("header", True).option("enforceSchema", False)
    reader = reader.option("mode", "FAILFAST" if malformed == "fail" else "PERMISSIVE")
    record = [] if malformed in ("fail", "null") else [T.StructField(malformed, T.StringType())]
    if record:
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    parts = []
    for header, same in by_header.items():
        full = T.StructType([types.get(name, T.StructField(name, T.StringType())) for name in header] + record)
        parts.append(reader.schema(full).csv(same).select(*types, *(f.name for f in record)))
    return nulls_for_nans(union_all(parts) if len(parts) > 1 else parts[0])


def read_many(
    spark: SparkSession,
    paths: Sequence[str],
    schema: str | T.StructType | None = None,
    fmt: str = "csv",
    **options,
) -> DataFrame:
    """Read and stack several files.

    Files of one ``schema`` and header are a single scan. Without a schema every file keeps its own columns
    and the files are stacked by name, missing columns NULL.
    """
    if schema is not None:
        return read_table(spark, paths, schema, fmt, **options)
    return union_all([read_table(spark, p, None, fmt, **options) for p in paths])


def read_json_records(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
    flatten: bool = True,
) -> DataFrame:
    """Read JSON objects and lift the fields of nested objects one level; lists stay lists.

    A file holding one array is parsed whole by one task (``multi_line``), unless :func:`read_json_array` reads it; files with one
    object per line are splittable and should be read with ``multi_line=False``.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    return flatten_structs(df) if flatten else df


def read_json_array(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, mode: str = "FAILFAST", flatten: bool = True
) -> DataFrame:
    """The objects of files that hold one JSON array each, however large, read by many tasks a file.

    The same rows as :func:`read_json_records` with ``multi_line``; see :mod:`tallywork.sources.json_arrays`. A text that is no
    object of ``schema`` fails the read, or gives a row of NULLs with ``mode="PERMISSIVE"``.
    """
    objects = array_records(spark, path).select(F.from_json("text", schema, {"mode": mode}).alias("o")).select("o.*")
    return flatten_structs(objects) if flatten else objects


def flatten_structs(df: DataFrame) -> DataFrame:
    """``a: {b, c}`` becomes ``a_b, a_c``."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            out += [F.col(field.name)[inner].alias(f"{field.name}_{inner}")
                    for inner in field.dataType.names]
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def load_table(
    df: DataFrame, name: str, mode: str = "replace", stored: bool = False, path: str | None = None
) -> None:
    """Make ``df`` known to SQL as ``name``: as a view, or as a stored table.

    ``mode`` is ``replace`` or ``fail`` (an existing table is an error).
    """
    if stored:
        writer = df.write.mode("overwrite" if mode == "replace" else "error")
        if path is not None:
            writer = writer.option("path", path)
        writer.saveAsTable(name)
    elif mode == "replace":
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a stored table or view if there is one."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def create_table_as(
    spark: SparkSession, name: str, query: DataFrame | str, path: str | None = None
) -> DataFrame:
    """Store the rows of a query as a new table, replacing an older one, and return it.

    With ``path`` the files lie there instead of in the warehouse folder.
    """
    df = spark.sql(query) if isinstance(query, str) else query
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def write_csv(
    df: DataFrame, path: str, row_ids: Sequence[str] | None = None, id_name: str = "_row", start: int = 0
) -> None:
    """Write CSV part files with a header.

    ``row_ids`` names the columns whose order numbers the rows from ``start`` in a leading column.
    """
    if row_ids is not None:
        df = renumber(df, row_ids, id_name, start).select(id_name, *df.columns)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write Parquet, the format between stages: types survive and scans can skip columns and folders."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def price_series(df: DataFrame, date: str, close: str) -> DataFrame:
    """(date, close) in date order."""
    return df.select(F.to_date(date).alias("date"), F.col(close).alias("close")).orderBy("date")
