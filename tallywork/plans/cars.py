"""Yearly and recession reports on car sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators.aggregates import (
    group_mean, mean_of_sums, partial_sums, shares_of_rows, sum_of_sums, total_where,
)
from tallywork.operators.filters import filter_compare
from tallywork.operators.stats import mean_with_ci
from tallywork.session import write_scratch

YEARLY = "Yearly Statistics"
RECESSION = "Recession Period Statistics"

SALES, ADS, TYPE = "Automobile_Sales", "Advertising_Expenditure", "Vehicle_Type"


PERIOD_KEYS = ["Year", "Month", "Recession", TYPE]


def in_recession(cars: DataFrame, flag: int = 1) -> DataFrame:
    return filter_compare(cars, "Recession", "==", flag)


def _sums(cars: DataFrame, staged: bool) -> DataFrame:
    """One grouping that every table of a report follows from, written if ``staged``."""
    partial = partial_sums(cars, PERIOD_KEYS, [SALES, ADS, "Price", "GDP"])
    return write_scratch(partial, "car-sums") if staged else partial


def _ads_by_type(sums: DataFrame) -> DataFrame:
    return shares_of_rows(sum_of_sums(sums, TYPE, ADS), ADS)


def recession_report(cars: DataFrame, staged: bool = True) -> dict[str, DataFrame]:
    """Sales and advertising during recessions."""
    rec = _sums(in_recession(cars), staged)
    return {
        "sales_by_year": mean_of_sums(rec, "Year", SALES),
        "sales_by_type": mean_of_sums(rec, TYPE, SALES),
        "ads_by_type": _ads_by_type(rec),
        # a rate may have many values: grouped by itself, it doesn't swell the sums that the others share
        "sales_by_unemployment": group_mean(in_recession(cars), ["unemployment_rate", TYPE], SALES),
    }


def yearly_report(cars: DataFrame, year: int, staged: bool = True) -> dict[str, DataFrame]:
    """Sales over all years and months, and the given year's sales and advertising by type."""
    sums = _sums(cars, staged)
    chosen = filter_compare(sums, "Year", "==", int(year))
    return {
        "sales_by_year": mean_of_sums(sums, "Year", SALES),
        "sales_by_month": sum_of_sums(sums, "Month", SALES),
        "sales_by_type": mean_of_sums(chosen, TYPE, SALES),
        "ads_by_type": _ads_by_type(chosen),
    }


def run_report(
    name: str, cars: DataFrame, year: int | None = None, staged: bool = True
) -> dict[str, DataFrame]:
    """A report by its name; the yearly one is empty unless a year is chosen."""
    if name == RECESSION:
        return recession_report(cars, staged)
    if name == YEARLY and year:
        return yearly_report(cars, year, staged)
    return {}


def recession_comparison(cars: DataFrame, staged: bool = True) -> dict[str, DataFrame]:
    """Recession against the other years."""
    sums = _sums(cars, staged)
    rec = in_recession(sums)
    periods = total_where(sums, {
        "Recession": F.col("Recession") == 1,
        "Non-Recession": F.col("Recession") == 0,
    }, f"{ADS}_sum", empty=0)
    rows = F.array(*[F.struct(F.lit(c).alias("period"), F.col(f"`{c}`").alias(ADS)) for c in periods.columns])
    return {
        "gdp_in_recession": mean_of_sums(rec, "Year", "GDP"),
        "gdp_otherwise": mean_of_sums(in_recession(sums, 0), "Year", "GDP"),
        "sales_by_year_and_type": mean_of_sums(rec, ["Year", TYPE], SALES),
        "price_and_sales_by_type": mean_of_sums(rec, TYPE, ["Price", SALES]),
        "ads_by_period": shares_of_rows(periods.select(F.inline(rows)), ADS),
        "ads_by_type": _ads_by_type(rec),
    }


def sales_trend(cars: DataFrame, n_boot: int = 1000) -> DataFrame:
    """Mean sales with their band per year, vehicle type and recession flag."""
    return mean_with_ci(cars, ["Year", TYPE, "Recession"], SALES, n_boot)


def bubble_points(cars: DataFrame) -> DataFrame:
    """Points of the seasonality chart: weight, sales, year, and advertising scaled to a size."""
    return cars.select("Seasonality_Weight", SALES, "Year", (F.col(ADS) / 5).alias("size"))
