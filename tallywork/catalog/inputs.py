"""The given tables in the roles of the analysed ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.catalog.registry import Tables
from tallywork.functions.scalars import json_field

# rides: one per line item, from the order date to the shipping date
RIDES = """rides AS (
    SELECT o_orderkey AS ride_id, o_orderpriority AS rideable_type, o_orderdate AS started_at,
           l_shipdate AS ended_at, o_orderstatus AS member_casual
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

CLEAN_RIDES = RIDES + """, clean AS (
    SELECT *, date_sub('minute', started_at, ended_at) AS ride_length, dayname(started_at) AS weekday,
           month(started_at) AS month, monthname(started_at) AS month_name
    FROM rides WHERE date_sub('minute', started_at, ended_at) > 0)"""


def rides(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_shipdate")
    return lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("ride_id"), F.col("o_orderpriority").alias("rideable_type"),
        F.col("o_orderdate").alias("started_at"), F.col("l_shipdate").alias("ended_at"),
        F.col("o_orderstatus").alias("member_casual"))


# car sales: one per line item
CARS = """cars AS (
    SELECT l_orderkey, l_linenumber, l_partkey, year(o_orderdate) AS "Year", month(o_orderdate) AS "Month",
           p_type AS "Vehicle_Type", l_quantity AS "Automobile_Sales", p_retailprice AS "Price",
           o_totalprice AS "GDP", l_tax AS "Seasonality_Weight", l_discount AS unemployment_rate,
           l_extendedprice AS "Advertising_Expenditure",
           CASE WHEN year(o_orderdate) IN (1998, 2001) THEN 1 ELSE 0 END AS "Recession"
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def cars(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(
        t.part, F.col("p_partkey") == F.col("l_partkey"))
    year = F.year("o_orderdate")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        year.cast("long").alias("Year"), F.month("o_orderdate").cast("long").alias("Month"),
        F.col("p_type").alias("Vehicle_Type"), F.col("l_quantity").alias("Automobile_Sales"),
        F.col("p_retailprice").alias("Price"), F.col("o_totalprice").alias("GDP"),
        F.col("l_tax").alias("Seasonality_Weight"), F.col("l_discount").alias("unemployment_rate"),
        F.col("l_extendedprice").alias("Advertising_Expenditure"),
        F.when(year.isin(1998, 2001), 1).otherwise(0).alias("Recession"))


# launches: one per line item
LAUNCHES = """launches AS (
    SELECT l_shipdate::DATE AS "Date", p_name AS "Launch_Site", l_quantity AS "Payload_Mass",
           c_mktsegment AS "Customer", p_brand AS "Booster_Version", l_returnflag AS "Landing_Outcome",
           l_linestatus AS "Mission_Outcome", l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey)"""


def launches(t: Tables) -> DataFrame:
    joined = (
        t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
        .join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey")))
    return joined.select(
        F.to_date("l_shipdate").alias("Date"), F.col("p_name").alias("Launch_Site"),
        F.col("l_quantity").alias("Payload_Mass"), F.col("c_mktsegment").alias("Customer"),
        F.col("p_brand").alias("Booster_Version"), F.col("l_returnflag").alias("Landing_Outcome"),
        F.col("l_linestatus").alias("Mission_Outcome"), "l_orderkey", "l_linenumber", "l_partkey")


# network log: one record per event; the field k of the JSON text supplies protocol and length
LOG = """log AS (
    SELECT event_id, ts, event_type AS attack_type, user_id AS account, value,
           CAST(props->>'$.k' AS BIGINT) AS packet_length,
           CASE WHEN CAST(props->>'$.k' AS BIGINT) < 34 THEN 'DNS'
                WHEN CAST(props->>'$.k' AS BIGINT) < 67 THEN 'HTTP' ELSE 'FTP' END AS protocol,
           CASE WHEN value < 30 THEN 'TCP' WHEN value < 80 THEN 'UDP' ELSE 'ICMP' END AS transport,
           value > 50 AS ioc_detected
    FROM events)"""


def log(t: Tables) -> DataFrame:
    k = json_field(F.col("props"), "$.k", "long")
    value = F.col("value")
    return t.events.select(
        "event_id", "ts", F.col("event_type").alias("attack_type"), F.col("user_id").alias("account"),
        "value", k.alias("packet_length"),
        F.when(k < 34, "DNS").when(k < 67, "HTTP").otherwise("FTP").alias("protocol"),
        F.when(value < 30, "TCP").when(value < 80, "UDP").otherwise("ICMP").alias("transport"),
        (value > 50).alias("ioc_detected"))


# line items with missing values: a discount of 0 and a tax of 0 count as missing
GAPS = """gaps AS (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag
    FROM lineitem)"""


def gaps(t: Tables) -> DataFrame:
    def zero_is_missing(col: str) -> Column:
        return F.nullif(F.col(col), F.lit(0.0)).alias(col)

    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        zero_is_missing("l_discount"), zero_is_missing("l_tax"), "l_returnflag")


# three hourly tables per account, as trackers deliver them
HOURLY = """hours AS (
    SELECT user_id AS "Id", date_trunc('hour', ts) AS hour, event_type, value FROM events),
steps AS (SELECT "Id", hour, count(*) AS steps FROM hours WHERE event_type <> 'error' GROUP BY ALL),
calories AS (SELECT "Id", hour, sum(value) AS calories FROM hours WHERE event_type <> 'signup' GROUP BY ALL),
intensities AS (SELECT "Id", hour, max(value) AS intensity FROM hours WHERE event_type <> 'view' GROUP BY ALL)"""


def hourly(t: Tables) -> list[DataFrame]:
    hours = t.events.select(F.col("user_id").alias("Id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                            "event_type", "value")

    def table(without: str, aggregate: Column) -> DataFrame:
        return hours.filter(F.col("event_type") != without).groupBy("Id", "hour").agg(aggregate)

    return [
        table("error", F.count(F.lit(1)).alias("steps")),
        table("signup", F.sum("value").alias("calories")),
        table("view", F.max("value").alias("intensity")),
    ]
