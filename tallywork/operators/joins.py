"""Merges, dimension lookups and completion of categories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.session import write_scratch

_SALT = "__salt"
_APART = "_apart"


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", na_matches: bool = True
) -> DataFrame:
    """Equi-join on same-named keys, kept from the left; missing keys match if ``na_matches``.

    Apart from the keys the two sides must not share column names.
    """
    theirs = {k: f"__right_{k}" for k in keys}
    pairs = [
        F.col(k).eqNullSafe(F.col(r)) if na_matches else F.col(k) == F.col(r)
        for k, r in theirs.items()
    ]
    renamed = right.select([F.col(c).alias(theirs.get(c, c)) for c in right.columns])
    return left.join(renamed, reduce(lambda a, b: a & b, pairs), how).drop(*theirs.values())


def hot_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Key combinations holding more than ``share`` of the rows: by definition under 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.filter(F.col("__n") > share * total).select(*keys)


def merge_inner(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    na_matches: bool = True,
    hot_share: float | None = None,
    salts: int = 64,
) -> DataFrame:
    """Inner equi-join on ``keys``; other columns present on both sides get the suffixes.

    Missing keys match each other unless ``na_matches`` is off. Skew is adaptive execution's task
    by default. With ``hot_share`` the keys holding more than that share of the left rows are
    spread over ``salts`` tasks: each left row of such a key takes a salt from its place in the left table, which
    is written first, so that equal rows are spread as well and a retried task finds the same places; the
    right rows of such a key are repeated once per salt. No row is lost or invented.

    Rows whose keys are missing match each other as any equal keys do, so many of them on both sides make a product
    of their numbers; turn ``na_matches`` off where missing means unknown.
    """
    keys = list(keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    columns = keys + [c for c in left.columns + right.columns if c not in keys]
    if hot_share is None:
        return join_on(left, right, keys, "inner", na_matches).select(*columns)
    left = write_scratch(left, "merge")
    # at most 1/hot_share rows, so the parameter bounds this broadcast
    hot = F.broadcast(hot_keys(left, keys, hot_share).withColumn("__hot", F.lit(True)))
    own = F.when(F.col("__hot"), F.col("__place")).otherwise(F.lit(0))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = join_on(left.withColumn("__place", place), hot, keys, "left").withColumn(_SALT, own).drop("__hot", "__place")
    right = join_on(right, hot, keys, "left").withColumn(_SALT, F.explode(every)).drop("__hot")
    return join_on(left, right, [*keys, _SALT], "inner", na_matches).select(*columns)


def merge_all(frames: Sequence[DataFrame], keys: Sequence[str], **options) -> DataFrame:
    """Merge several tables on one key set; every join reuses the first one's partitioning."""
    return reduce(lambda a, b: merge_inner(a, b, keys, **options), frames)


def store_for_merges(
    frames: dict[str, DataFrame], keys: Sequence[str], buckets: int, hot_share: float = 0.001, folder: str | None = None
) -> None:
    """Store tables once, dealt by ``keys``, so that :func:`merge_stored` merges them without moving their rows.

    Each name becomes a table in ``buckets`` buckets of its keys, one sorted file a bucket, and a table ``<name>_apart`` of
    the rows that buckets don't serve: those with a missing key, and those of keys that hold more than ``hot_share`` of the
    rows of any of the tables, which would make one bucket long. Tables that are to be merged are stored together, as they
    must agree on what lies apart. Choose ``buckets`` so that a bucket of the largest table fits a task's memory. Older
    tables of these names are replaced. ``folder`` holds the files instead of the warehouse.
    """
    keys = list(keys)
    # each table is computed once: the counts and both parts read what is written here
    written = {name: write_scratch(df, "merge-table") for name, df in frames.items()}
    # at most 1/hot_share keys a table
    hot = reduce(DataFrame.unionByName, [hot_keys(df.na.drop(subset=keys), keys, hot_share) for df in written.values()])
    hot = write_scratch(hot.distinct(), "hot-keys")
    for name, df in written.items():
        whole = df.na.drop(subset=keys)
        missing = df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))
        marked = F.broadcast(hot)
        apart = missing.unionByName(whole.join(marked, keys, "left_semi"))
        dealt = whole.join(marked, keys, "left_anti").repartition(buckets, *keys)
        for table, rows, bucketed in ((name, dealt, True), (name + _APART, apart, False)):
            writer = rows.write.mode("overwrite").format("parquet")
            if bucketed:
                writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
            if folder is not None:
                writer = writer.option("path", f"{folder.rstrip('/')}/{table}")
            writer.saveAsTable(table)


def merge_stored(
    spark: SparkSession, names: Sequence[str], keys: Sequence[str], na_matches: bool = True, hot_share: float = 0.01, salts: int = 64
) -> DataFrame:
    """Inner merge of tables of :func:`store_for_merges`: the rows of :func:`merge_all` on the tables as they were.

    Buckets meet in place, without an exchange. The rows apart, of missing and of hot keys, are merged beside them, with salts
    for keys that hold more than ``hot_share`` of those.
    """
    dealt = merge_all([spark.table(name) for name in names], keys, na_matches=False)
    apart = [spark.table(name + _APART) for name in names]
    return dealt.unionByName(merge_all(apart, keys, na_matches=na_matches, hot_share=hot_share, salts=salts))


def enrich(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str]
) -> DataFrame:
    """Look up attributes of a dimension: every fact row stays, unknown ids give NULL.

    ``columns`` maps dimension columns to output names. ``dim_key`` must be unique in ``dim``.
    No broadcast is forced: Catalyst takes one when the pruned dimension is below
    ``spark.sql.autoBroadcastJoinThreshold`` and a shuffle join otherwise.
    """
    lookup = dim.select(
        F.col(dim_key).alias("__id"), *[F.col(c).alias(name) for c, name in columns.items()]
    )
    return facts.join(lookup, F.col(fact_key) == F.col("__id"), "left").drop("__id")


def complete_categories(
    grouped: DataFrame, keys: Sequence[str], category: str, levels: Sequence[str]
) -> DataFrame:
    """Fill a grouped result to every (observed key, level); values of absent pairs are NULL.

    A ``category`` outside ``levels`` drops out, as a value outside an ordered category does. The
    few levels found per key are gathered in a map and read back level by level: a self-join with
    the observed keys would compute the grouped result, and so scan its facts, twice.
    """
    values = [c for c in grouped.columns if c not in (*keys, category)]
    every = [F.lit(level) for level in levels]
    entry = F.struct(F.col(category), F.struct(*values))
    found = grouped.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col(category).isin(list(levels)), entry))).alias("__found"))
    full = found.select(*keys, "__found", F.explode(F.array(*every)).alias(category))
    row = F.try_element_at("__found", F.col(category))
    return full.select(*keys, category, *[row[v].alias(v) for v in values]).select(*grouped.columns)


def rows_at_extreme(
    df: DataFrame, value: str, extreme: str = "max", cols: Sequence[str] | None = None
) -> DataFrame:
    """Rows holding the global maximum (or minimum), ties included; distinct ``cols`` if given."""
    best = {"max": F.max, "min": F.min}[extreme]
    rows = df.filter(F.col(value) == df.agg(best(value)).scalar())
    return rows.select(*cols).distinct() if cols else rows
