"""Correlation, boxplot summaries, regression lines and bootstrap bands."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.operators.joins import join_on
from tallywork.operators.quantiles import QUARTILES, quantiles, widen
from tallywork.session import write_scratch

# executors get this module's functions with the task and need no copy of the package
register_pickle_by_value(sys.modules[__name__])

_FENCES = dict(zip(QUARTILES, ("q1", "median", "q3"), strict=True))


def pair_correlation(df: DataFrame, x: str, y: str, out: str = "r") -> DataFrame:
    """Pearson correlation over the rows where both values are present."""
    return df.agg(F.corr(x, y).alias(out))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, r) for all pairs, each over its own complete rows, in one pass.

    Half of the matrix is computed and mirrored.
    """
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def wide_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, r) as :func:`correlation_matrix`, for hundreds of columns.

    Tasks multiply matrices of their rows, values and presence apart, so that each pair is over its own complete rows;
    what is added up is a row per task and pair. Columns are standardised first by a pass of their means and deviations,
    which keeps far-off means from eating the digits. A task holds 32 bytes for each pair of columns in either order.
    NULL, NaN and infinite values are missing; r is missing where one side doesn't vary, or has no rows.
    """
    cols = list(cols)
    finite = [F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")).alias(f"c{i}")
              for i, c in enumerate(cols)]
    numbers = df.select(*finite)
    moments = numbers.agg(*[F.avg(c).alias(f"m{c}") for c in numbers.columns],
                          *[F.stddev_samp(c).alias(f"s{c}") for c in numbers.columns]).first()
    centre = np.array([0.0 if m is None else m for m in moments[:len(cols)]])
    spread = np.array([s or 0.0 for s in moments[len(cols):]])

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = np.zeros((4, len(centre), len(centre)))
        for frame in frames:
            values = frame.to_numpy(np.float64)
            there = ~np.isnan(values)
            # a column without spread is zero throughout
            z = np.where(there & (spread > 0), (values - centre) / np.where(spread > 0, spread, 1.0), 0.0)
            there = there.astype(np.float64)
            n += there.T @ there
            s += z.T @ there
            q += (z * z).T @ there
            p += z.T @ z
        i, j = np.triu_indices(len(centre))
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i],
                            "xx": q[i, j], "yy": q[j, i], "xy": p[i, j]})

    sums = numbers.mapInPandas(multiply, "i int, j int, n double, sx double, sy double, xx double, yy double, xy double")
    pair = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])

    def variation(squares: str, total: str) -> Column:
        """n squared times the variance; what rounding leaves of none is none."""
        full = F.col("n") * F.col(squares)
        rest = full - F.col(total) * F.col(total)
        return F.when(rest > full * 1e-12, rest)

    r = (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / (
        F.sqrt(variation("xx", "sx")) * F.sqrt(variation("yy", "sy")))
    name = F.array(*[F.lit(c) for c in cols])
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return (pair.select(F.when(F.abs(r) > 1, F.signum(r)).otherwise(r).alias("r"), F.explode(both).alias("at"))
            .select(F.get(name, "at.i").alias("x"), F.get(name, "at.j").alias("y"), "r"))


def regression_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, intercept, r2) of the least-squares line."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def _fences(df: DataFrame, group: str, value: str, reach: float) -> DataFrame:
    """(group, q1, median, q3, low_fence, high_fence), written: its size decides how it is joined."""
    wide = widen(quantiles(df, value, QUARTILES, [group]), [group], _FENCES)
    spread = F.col("q3") - F.col("q1")
    return write_scratch(wide.withColumns({
        "low_fence": F.col("q1") - reach * spread,
        "high_fence": F.col("q3") + reach * spread,
    }), "fences")


def _beyond(value: str) -> Column:
    return (F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))


def box_summary(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """(group, n, q1, median, q3, low_whisker, high_whisker, outliers).

    Whiskers are the farthest values within ``reach`` interquartile ranges of the box.
    """
    known = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    fenced = join_on(known, _fences(known, group, value, reach), [group], na_matches=False)
    inside = F.when(~_beyond(value), F.col(value))
    return fenced.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"),
        F.count_if(_beyond(value)).alias("outliers"),
    )


def outliers(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """The rows beyond the fences of their group."""
    fences = _fences(df.filter(F.col(group).isNotNull()), group, value, reach).select(group, "low_fence", "high_fence")
    return join_on(df, fences, [group], na_matches=False).filter(_beyond(value)).select(*df.columns)


def histogram(df: DataFrame, value: str, width: float, keys: Sequence[str] = (), start: float = 0.0) -> DataFrame:
    """(keys, bin, bin_start, count) for bins of equal width."""
    at = F.floor((F.col(value) - F.lit(start)) / F.lit(width))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.select(*keys, "bin", (F.col("bin") * F.lit(width) + F.lit(start)).alias("bin_start"), "count")


_LADDER = 16  # a count is the sum of its binary digits up to here, and of pieces of 2 ** _LADDER


def _poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """(first, steps): a 32-bit draw at or above k of the steps weighs ``first + k`` in a Poisson(mean) distribution."""
    reach = int(12 * mean ** 0.5) + 16
    first = max(0, mean - reach)
    k = np.arange(first, mean + reach)
    logs = k * np.log(mean) - mean - np.array([math.lgamma(i + 1.0) for i in k])
    return first, np.minimum(np.round(np.cumsum(np.exp(logs)) * 2.0 ** 32), 2.0 ** 32).astype("uint64")


def _draws(row_hash: np.ndarray, piece: int, first: int, count: int) -> np.ndarray:
    """32-bit draws of each row for replicates ``first`` ... ``first + count``: splitmix64 of (row, piece, replicate)."""
    steps = np.arange(first // 2, (first + count + 1) // 2, dtype="uint64") + np.uint64(1)
    z = (row_hash ^ np.uint64(piece * 0xD1342543DE82EF95 % 2 ** 64))[:, None] + steps[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z.view("uint32")[:, first % 2:first % 2 + count]


def _cell_weights(row_hash: np.ndarray, count: np.ndarray, first: int, replicates: int) -> np.ndarray:
    """Poisson(count) weights: what ``count`` equal rows with Poisson(1) weights add up to.

    A sum of Poisson draws is a Poisson draw, so every binary digit of a count adds one draw of that mean, for all
    cells at once, whatever their counts. A pure function of the cell's hash and the replicate.
    """
    weight = np.zeros((count.size, replicates))
    for digit in range(_LADDER + 1):
        times = count >> digit if digit == _LADDER else count >> digit & 1
        if not times.any():
            continue
        low, steps = _poisson_steps(1 << digit)
        for time in range(int(times.max())):
            rows = np.flatnonzero(times > time)
            drawn = _draws(row_hash[rows], 1 + digit + (time << 6), first, replicates)
            weight[rows] += low + np.searchsorted(steps, drawn, side="right")
    return weight


def _replicate_sums(keys: list[str], n_boot: int, block: int = 200, rows: int = 1024):
    """Rows sorted by ``keys`` to (keys, sums, sizes), one row for each group that a task meets.

    The last group of a batch is carried on to the next, so only whole runs of a group are given out.
    """

    def add_up(part: pd.DataFrame, code: np.ndarray, groups: int) -> np.ndarray:
        value = part["__value"].to_numpy("float64")
        row_hash = part["__hash"].to_numpy("int64").view("uint64")
        cells = part["__count"].to_numpy("int64")
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        out = np.zeros((groups, 2, n_boot))
        for first in range(0, n_boot, block):
            last = min(first + block, n_boot)
            weight = _cell_weights(row_hash, cells, first, last - first)
            out[code[starts], 1, first:last] = np.add.reduceat(weight, starts, axis=0)
            out[code[starts], 0, first:last] = np.add.reduceat(weight * value[:, None], starts, axis=0)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_key = None, None

        def given(names: pd.DataFrame, sums: np.ndarray) -> pd.DataFrame:
            out = names.reset_index(drop=True).copy()
            out["__sum"], out["__size"] = list(sums[:, 0]), list(sums[:, 1])
            return out

        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at:at + rows].reset_index(drop=True)
                changed = (part[keys].ne(part[keys].shift()) & ~(part[keys].isna() & part[keys].shift().isna())).any(axis=1).to_numpy()
                changed[0] = False
                code = np.cumsum(changed)
                names = part[keys].iloc[np.flatnonzero(np.r_[True, changed[1:]])]
                sums = add_up(part, code, int(code[-1]) + 1)
                if held is not None:
                    if held_key.iloc[0].equals(names.iloc[0]):
                        sums[0] += held[0]
                    else:
                        yield given(held_key, held)
                if len(names) > 1:
                    yield given(names.iloc[:-1], sums[:-1])
                held, held_key = sums[-1:], names.iloc[-1:]
        if held is not None:
            yield given(held_key, held)
    return run


def _quantile_of(values: Column, share: float) -> Column:
    """Linear interpolation in an array; missing values are left out."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(share)
        low = F.get(v, F.floor(place).cast("int"))
        return low + (F.get(v, F.ceil(place).cast("int")) - low) * (place - F.floor(place))
    return F.element_at(F.transform(F.array(ordered), at), 1)


def mean_with_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    n_boot: int = 1000,
    level: float = 95.0,
    seed: int = 0,
) -> DataFrame:
    """(keys, mean, low, high): group means with a bootstrap band.

    Poisson bootstrap: in each replicate every row counts as often as a Poisson(1) weight says.
    Equal values of a group are counted first and weighted together, so repeated values collapse
    before the shuffle. The weights depend on group, value, replicate and ``seed`` alone, hence
    neither on the partitioning nor on retries. The cells are range-partitioned by group and hash: a small group
    lies in one task, a large one in as many as its size asks for, and each task gives out one pair of
    arrays of ``n_boot`` sums for each group that it meets.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).na.drop("any", subset=keys)
    cells = rows.groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(
        F.count(F.lit(1)).alias("__count"))
    drawn = cells.withColumn("__hash", F.xxhash64(*keys, "__value", F.lit(seed)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)
    spread = drawn.repartitionByRange(*keys, "__hash").sortWithinPartitions(*keys)
    sums = spread.mapInPandas(_replicate_sums(keys, n_boot), f"{schema}, __sum array<double>, __size array<double>")
    gathered = sums.groupBy(*keys).agg(  # a row for each task that met the group
        F.collect_list(F.struct("__sum", "__size")).alias("__parts"))

    def total(name: str) -> Column:
        zeros = F.array_repeat(F.lit(0.0), n_boot)
        return F.aggregate("__parts", zeros, lambda so_far, part: F.zip_with(so_far, part[name], lambda x, y: x + y))
    means_drawn = gathered.select(*keys, total("__sum").alias("__sum"), total("__size").alias("__size")).select(
        *keys, F.zip_with("__sum", "__size", F.try_divide).alias("__means"))
    tail = (100.0 - level) / 200.0
    band = means_drawn.select(
        *keys, _quantile_of(F.col("__means"), tail).alias("low"), _quantile_of(F.col("__means"), 1.0 - tail).alias("high"))
    means = cells.groupBy(*keys).agg(
        (F.sum(F.col("__value") * F.col("__count")) / F.sum("__count")).alias("mean"))
    return join_on(means, band, keys, "left", na_matches=False).select(*keys, "mean", "low", "high")
