"""Cleaning of activity tracker tables, and activity by weekday and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.dates import (
    WEEKDAYS_FROM_MONDAY, WEEKDAYS_FROM_SUNDAY, parse_month_day_year, parse_month_day_year_time,
    weekday_number,
)
from tallywork.functions.scalars import round_half_even
from tallywork.operators.aggregates import group_mean
from tallywork.operators.columns import lowercase_columns, recode
from tallywork.operators.joins import merge_all
from tallywork.operators.ordering import head, level_position, sort_by_levels
from tallywork.operators.profiles import duplicate_count, n_distinct
from tallywork.operators.sets import drop_duplicate_rows
from tallywork.session import write_scratch
from tallywork.sources.tables import write_csv

MINUTE_COLUMNS = ["fairlyactiveminutes", "lightlyactiveminutes", "sedentaryminutes", "veryactiveminutes"]


def clean_daily_activity(daily: DataFrame) -> DataFrame:
    """Dates parsed, weekday named and ordered, minutes summed up to hours."""
    df = lowercase_columns(daily).withColumn("activitydate", parse_month_day_year(F.col("activitydate")))
    minutes = sum((F.col(c) for c in MINUTE_COLUMNS[1:]), F.col(MINUTE_COLUMNS[0]))
    df = df.withColumns({
        "day_of_week": weekday_number(F.col("activitydate")),
        "total_active_hours": round_half_even(minutes / 60, 2),
    })
    df = recode(df, "day_of_week", dict(enumerate(WEEKDAYS_FROM_SUNDAY, start=1)))
    return df.withColumn("day_of_week_order", level_position("day_of_week", WEEKDAYS_FROM_MONDAY))


def clean_sleep(sleep: DataFrame) -> DataFrame:
    """Repeated rows removed, times parsed, minutes turned into hours."""
    df = drop_duplicate_rows(lowercase_columns(sleep))
    return df.withColumns({
        "sleepday": parse_month_day_year_time(F.col("sleepday")),
        "total_hour_in_bed": round_half_even(F.col("totaltimeinbed") / 60, 2),
        "total_hour_asleep": round_half_even(F.col("totalminutesasleep") / 60, 2),
    })


def merge_hourly(tables: Sequence[DataFrame]) -> DataFrame:
    """The hourly measures side by side, for hours present in every table."""
    df = lowercase_columns(merge_all(tables, ["Id", "ActivityHour"]))
    return df.withColumn("activityhour", parse_month_day_year_time(F.col("activityhour")))


def activity_cleaning(
    daily: DataFrame, sleep: DataFrame, weight: DataFrame, hourly: Sequence[DataFrame]
) -> dict[str, DataFrame]:
    """The three cleaned tables and the checks made on the way. The hourly merge is written once for all that use it."""
    merged = write_scratch(merge_hourly(hourly), "hourly")
    tables = {"daily_activity": clean_daily_activity(daily), "daily_sleep": clean_sleep(sleep),
              "hourly_activity": merged}
    checks = {
        "participants_daily": n_distinct(daily, "Id"), "participants_sleep": n_distinct(sleep, "Id"),
        "participants_weight": n_distinct(weight, "Id"), "participants_hourly": n_distinct(merged, "id"),
        "duplicates_daily": duplicate_count(daily), "duplicates_sleep": duplicate_count(sleep),
        "duplicates_hourly": duplicate_count(merged),
        "duplicates_sleep_after": duplicate_count(tables["daily_sleep"]),
    }
    return tables | checks


def export_cleaned(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the cleaned tables as CSV with a row number in front."""
    ids = {"daily_activity": ["id", "activitydate"], "daily_sleep": ["id", "sleepday"],
           "hourly_activity": ["id", "activityhour"]}
    for name, order in ids.items():
        rest = [c for c in tables[name].columns if c not in order]
        write_csv(tables[name], f"{folder}/{name}", [*order, *rest], start=1)


def minutes_by_weekday_and_type(
    df: DataFrame, minute_cols: Sequence[str], weekday: str = "day_of_week"
) -> DataFrame:
    """Mean minutes per weekday and activity type, Monday first.

    The means are taken side by side in one pass; only the seven result rows are turned long.
    """
    means = df.filter(F.col(weekday).isNotNull()).groupBy(weekday).agg(*[F.avg(c).alias(c) for c in minute_cols])
    long = means.unpivot([weekday], list(minute_cols), "activity_type", "mean_minutes")
    return sort_by_levels(long, weekday, WEEKDAYS_FROM_MONDAY, then=["activity_type"])


def steps_by_weekday(df: DataFrame, steps: str, weekday: str = "day_of_week") -> DataFrame:
    return sort_by_levels(group_mean(df, weekday, steps), weekday, WEEKDAYS_FROM_MONDAY)


def steps_by_hour(df: DataFrame, ts: str, steps: str) -> DataFrame:
    return group_mean(df.withColumn("hour", F.hour(ts)), "hour", steps)


def top_hours(df: DataFrame, ts: str, steps: str, n: int = 5) -> DataFrame:
    """The ``n`` hours of day with the highest mean."""
    return head(steps_by_hour(df, ts, steps), n, [F.desc(steps), F.asc("hour")], "rank")
