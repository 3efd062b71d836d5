"""Monitoring of network logs in batch: volumes, shares, spikes and unusual access.

The definitions of these analyses are this library's own. Scores compare a count with the mean and
deviation of its own key; those come from grouped aggregates joined back, never from a window that
would gather a busy key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.functions.dates import month_index
from tallywork.operators.aggregates import group_rows, value_counts, value_shares
from tallywork.operators.joins import join_on
from tallywork.operators.ordering import head
from tallywork.operators.stats import box_summary, histogram


def counts_per_period(log: DataFrame, period: Column, name: str = "period", condition: Column | None = None) -> DataFrame:
    """Rows per period, ranked by count: the busiest period has rank 1, ties share a rank.

    ``period`` must have few values (months, days), as the ranks are drawn over the periods.
    """
    rows = log if condition is None else log.filter(condition)
    counts = rows.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.rank().over(Window.orderBy(F.desc("count"))))


def busiest_periods(log: DataFrame, period: Column, n: int, name: str = "period") -> DataFrame:
    counts = log.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return head(counts, n, [F.desc("count"), F.asc(name)], "rank")


def detection_by_period(log: DataFrame, period: Column, detected: Column, name: str = "period") -> DataFrame:
    """(period, detected, not_detected), both counted in one pass."""
    return log.groupBy(period.alias(name)).agg(
        F.count_if(detected).alias("detected"), F.count_if(~F.coalesce(detected, F.lit(False))).alias("not_detected"))


def shares_by(log: DataFrame, col: str, digits: int = 1) -> DataFrame:
    return value_shares(log, col, digits)


def attempts_by_transport(log: DataFrame, transport: str) -> DataFrame:
    return value_counts(log, transport, "attempts")


def packet_length_summary(log: DataFrame, attack: str, length: str) -> DataFrame:
    """Boxplot summary of the packet length per attack type."""
    return box_summary(log, attack, length)


def packet_length_histogram(log: DataFrame, attack: str, length: str, width: float) -> DataFrame:
    """Packets per attack type and bin of the packet length."""
    return histogram(log.filter(F.col(attack).isNotNull()), length, width, [attack])


def _scores(counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Adds mean, deviation and z: how far ``count`` lies above its key's mean, in deviations.

    All follow from whole sums, so neither the order of the rows nor the partitions move a score that lies right on a bound.
    """
    whole = F.col(count).cast("decimal(19,0)")
    own = counts.groupBy(*keys).agg(
        F.count(count).alias("__n"), F.sum(count).alias("__total"), F.sum(whole * whole).alias("__squares"))
    n, total = F.col("__n").cast("decimal(19,0)"), F.col("__total").cast("decimal(19,0)")
    own = own.withColumn("__spread", F.sqrt((n * F.col("__squares") - total * total).cast("double")))  # n deviations
    scored = join_on(counts, own, keys).withColumns({
        "mean": F.col("__total") / F.col("__n"), "deviation": F.col("__spread") / F.col("__n"),
        "z": (F.col("__n") * F.col(count) - F.col("__total")) / F.nullif(F.col("__spread"), F.lit(0.0))})
    return scored.drop("__n", "__total", "__squares", "__spread")


def traffic_spikes(log: DataFrame, ts: str, key: str, width: str = "1 hour", k: float = 3.0) -> DataFrame:
    """Time buckets whose count lies more than ``k`` deviations above the key's own mean bucket.

    Mean and deviation are over all buckets from the log's first to its last, those without an event of the key as 0;
    they follow from the totals, so no empty row is made. A key with a constant rate has no deviation and no spike.
    """
    counts = log.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    counts = counts.select(key, F.col("w.start").alias("bucket"), "count")
    seconds = F.unix_micros(F.max("bucket").cast("timestamp")) - F.unix_micros(F.min("bucket").cast("timestamp"))
    span = counts.agg((seconds / (pd.Timedelta(width).total_seconds() * 1e6) + 1).alias("n")).scalar()
    own = counts.groupBy(key).agg(F.sum("count").alias("total"), F.sum(F.col("count") * F.col("count")).alias("squares"))
    mean = F.col("total") / span
    spread = F.sqrt(F.greatest(F.col("squares") / span - mean * mean, F.lit(0.0)))
    scored = join_on(counts, own.select(key, mean.alias("mean"), spread.alias("deviation")), [key])
    z = (F.col("count") - F.col("mean")) / F.nullif(F.col("deviation"), F.lit(0.0))
    return scored.withColumn("z", z).filter(F.col("z") > k)


def credential_stuffing(
    log: DataFrame, ts: str, account: str, source: str, width: str, slide: str,
    min_attempts: int, min_sources: int,
) -> DataFrame:
    """Accounts with many attempts from many sources within one sliding window.

    Attempts are first counted per source and step of the window, so that a busy account is one row per step and source.
    Such a count is not repeated for the windows it lies in: it joins them at the first window that holds its step and leaves
    after the last. A source joins if it had no attempt in a window that meets or overlaps these, and leaves likewise, so that
    it counts once in each window. Running totals, over two rows per step of an account at most, give the windows between
    two changes alike; only those of suspects are written out. ``width`` must be a multiple of ``slide``.
    """
    if pd.Timedelta(width) % pd.Timedelta(slide) != pd.Timedelta(0):
        raise ValueError(f"window width {width} is no multiple of its step {slide}")
    wide, step = F.expr(f"interval {width}"), F.expr(f"interval {slide}")
    per_step = log.groupBy(F.window(ts, slide).start.alias("step"), F.col(account).alias("account"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("account", "source").orderBy("step")
    known = F.col("source").isNotNull()
    joins = known & F.coalesce(F.lag("step").over(own) + wide < F.col("step"), F.lit(True))
    leaves = known & F.coalesce(F.col("step") + wide < F.lead("step").over(own), F.lit(True))
    cells = per_step.select("account", "step", "n", joins.cast("long").alias("joins"), leaves.cast("long").alias("leaves")).groupBy(
        "account", "step").agg(*[F.sum(c).alias(c) for c in ("n", "joins", "leaves")])
    changes = cells.select("account", F.inline(F.array(
        F.struct((F.col("step") - wide + step).alias("at"), F.col("n").alias("n"), F.col("joins").alias("sources")),
        F.struct((F.col("step") + step).alias("at"), (-F.col("n")).alias("n"), (-F.col("leaves")).alias("sources")))))
    until_now = Window.partitionBy("account").orderBy("at")  # rows of the same time are summed together
    totals = changes.select(
        "account", "at", F.sum("n").over(until_now).alias("attempts"), F.sum("sources").over(until_now).alias("sources"),
        F.lead("at").over(until_now).alias("next"))
    suspects = totals.filter(
        (F.col("attempts") >= max(min_attempts, 1)) & (F.col("sources") >= min_sources) & (F.col("at") < F.col("next")))
    starts = F.explode(F.sequence("at", F.col("next") - step, step)).alias("window_start")
    windows = suspects.select(starts, F.col("account").alias(account), "attempts", "sources")
    return windows.select("window_start", (F.col("window_start") + wide).alias("window_end"), account, "attempts", "sources")


def unusual_access(log: DataFrame, user: str, resource: str, k: float = 3.0) -> DataFrame:
    """(user, resource) pairs accessed far more often than the user's mean resource."""
    return _scores(group_rows(log, [user, resource]), [user], "count").filter(F.col("z") > k)


def count_trend(log: DataFrame, period: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, intercept, next_period, next_count) of counts per numbered period."""
    counts = log.groupBy(*keys, period.alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    line = counts.groupBy(*keys).agg(
        F.regr_slope("__n", "__t").alias("slope"), F.regr_intercept("__n", "__t").alias("intercept"),
        (F.max("__t") + 1).alias("next_period"))
    forecast = F.col("intercept") + F.col("slope") * F.col("next_period")
    return line.withColumn("next_count", forecast)


def monthly_trend(log: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    return count_trend(log, month_index(F.col(ts)), keys)
