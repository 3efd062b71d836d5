"""Usage of shared bikes by rider type, bike type, weekday and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywork.functions.dates import WEEKDAYS_FROM_SUNDAY, calendar_columns, whole_minutes
from tallywork.operators.aggregates import (
    count_of_sums, group_mean, mean_of_sums, partial_sums, pivot_mean, shares_of_counts, shares_of_rows,
)
from tallywork.operators.columns import recode
from tallywork.operators.filters import drop_incomplete_rows, filter_compare
from tallywork.operators.joins import complete_categories
from tallywork.operators.ordering import sort_by_levels
from tallywork.session import write_scratch
from tallywork.streaming.kept_sums import keep_sums

# fixed values: labels of rider types, bike types, weekdays and months
RIDER_LABELS = {"member": "會員", "casual": "臨時使用者"}
BIKE_LABELS = {"classic_bike": "普通自行車", "electric_bike": "電動輔助自行車", "docked_bike": "共享單車"}
WEEKDAY_LABELS = {
    "Sunday": "星期日", "Monday": "星期一", "Tuesday": "星期二", "Wednesday": "星期三",
    "Thursday": "星期四", "Friday": "星期五", "Saturday": "星期六",
}
MONTH_LABELS = {
    1: "一月", 2: "二月", 3: "三月", 4: "四月", 5: "五月", 6: "六月",
    7: "七月", 8: "八月", 9: "九月", 10: "十月", 11: "十一月", 12: "十二月",
}

#: what the report's finest grouping is keyed by
SUM_KEYS = ["member_casual", "month", "month_name", "weekday", "rideable_type"]


def clean_rides(rides: DataFrame) -> DataFrame:
    """Complete rides of at least a minute, with their length in whole minutes and calendar fields."""
    length = whole_minutes(F.col("started_at"), F.col("ended_at"))
    timed = drop_incomplete_rows(rides).withColumn("ride_length", length)
    kept = filter_compare(timed, "ride_length", ">", 0)
    return kept.withColumns(calendar_columns(F.col("started_at")))


def _in_weekday_order(means: DataFrame, rider: str) -> DataFrame:
    full = complete_categories(means, [rider], "weekday", WEEKDAYS_FROM_SUNDAY)
    return sort_by_levels(full, "weekday", WEEKDAYS_FROM_SUNDAY, then=[rider])


def mean_length_by_weekday(rides: DataFrame, rider: str = "member_casual") -> DataFrame:
    """Mean ride length per rider type and weekday, Sunday first, with NULL for days without rides."""
    return _in_weekday_order(group_mean(rides, [rider, "weekday"], "ride_length"), rider)


def ride_sums(rides: DataFrame) -> DataFrame:
    """Lengths and rides by rider type, bike type, weekday and month: all that the report's tables need."""
    return partial_sums(rides, SUM_KEYS, ["ride_length"], ["ride_id"])


def ride_usage_report(rides: DataFrame, staged: bool = True) -> dict[str, DataFrame]:
    """The tables behind the charts, from rides prepared by :func:`clean_rides`.

    All come from one grouping by rider type, bike type, weekday and month. ``staged`` writes it,
    so that asking for every table reads the rides once; unstaged, each table runs on its own.
    """
    partial = ride_sums(rides)
    return report_of_sums(write_scratch(partial, "ride-sums") if staged else partial)


def keep_ride_sums(rides: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Add the rides that have arrived, a stream prepared by :func:`clean_rides`, to the sums kept in ``folder``.

    ``report_of_sums(stored_sums(spark, folder, SUM_KEYS))`` is then the report on all rides so far.
    """
    return keep_sums(rides, ride_sums, folder, checkpoint)


def report_of_sums(partial: DataFrame) -> dict[str, DataFrame]:
    """The report's tables from :func:`ride_sums`."""
    rider = "member_casual"
    months = [rider, "month", "month_name"]
    by_rider = mean_of_sums(partial, rider, "ride_length")
    return {
        "rider_share": shares_of_counts(count_of_sums(partial, rider, "ride_length", "count"), rider),
        "length_by_rider": by_rider,
        "length_share_by_rider": shares_of_rows(by_rider, "ride_length"),
        "length_by_weekday": _in_weekday_order(mean_of_sums(partial, [rider, "weekday"], "ride_length"), rider),
        "length_by_month": mean_of_sums(partial, months, "ride_length"),
        "rides_by_bike": count_of_sums(partial, [rider, "rideable_type"], "ride_id", "count"),
        "rides_by_month": count_of_sums(partial, months, "ride_id"),
    }


def labelled(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables with label columns for every coded column they have."""
    maps = {
        "member_casual": RIDER_LABELS, "rideable_type": BIKE_LABELS,
        "weekday": WEEKDAY_LABELS, "month": MONTH_LABELS,
    }
    out = {}
    for name, table in report.items():
        for col, labels in maps.items():
            if col in table.columns:
                table = recode(table, col, labels, f"{col}_label")
        out[name] = table
    return out


def length_by_rider_and_month(length_by_month: DataFrame) -> DataFrame:
    """Cross table of the monthly means: a row per rider type, a column per month number."""
    return pivot_mean(length_by_month, "member_casual", "month", "ride_length", list(range(1, 13)))
