"""Date and time functions.

All of them accept zoned and zone-free timestamps. Names of days and months are English.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names in calendar order
WEEKDAYS_FROM_SUNDAY = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKDAYS_FROM_MONDAY = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    """ISO text to a timestamp; text that is no timestamp gives NULL, or an error when ``strict``."""
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def parse_month_day_year(text: Column) -> Column:
    """``4/12/2016`` to a date; failures give NULL."""
    return F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def parse_month_day_year_time(text: Column) -> Column:
    """``4/12/2016 3:05:00 PM`` to a timestamp; failures give NULL."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a"))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def _name(names: list[str], number: Column) -> Column:
    # picking from a literal list is several times faster than formatting each timestamp
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def day_name(ts: Column) -> Column:
    return _name(WEEKDAYS_FROM_SUNDAY, F.dayofweek(ts))


def month_name(ts: Column) -> Column:
    return _name(MONTHS, F.month(ts))


def weekday_number(ts: Column) -> Column:
    """1 for Sunday to 7 for Saturday."""
    return F.dayofweek(ts)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end`` as a double, negative if ``end`` is earlier.

    Subtracting the timestamps keeps zone-free ones zone-free, so no daylight shift can enter.
    """
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / 60


def whole_minutes(start: Column, end: Column) -> Column:
    """Elapsed minutes truncated toward zero: anything under a minute counts as 0."""
    return (end - start).cast("interval minute").cast("int")


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The calendar fields that ride and sales tables derive from one timestamp."""
    return {
        "weekday": day_name(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "month_name": month_name(ts),
        "year": F.year(ts),
    }


def month_index(ts: Column) -> Column:
    """Months since year 0, a running number for trends over months."""
    return F.year(ts) * 12 + F.month(ts) - 1
