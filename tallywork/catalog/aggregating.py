"""Grouped and global aggregates, frequency tables, shares and cross tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallywork.catalog.inputs import CARS, CLEAN_RIDES, GAPS, cars, gaps, rides
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators import aggregates as A
from tallywork.plans.rides import clean_rides

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("mean_by_key", "A1", f"""
    WITH {CARS} SELECT "Year", round(avg("Automobile_Sales"), 4) AS "Automobile_Sales" FROM cars GROUP BY ALL""")
def _(t: Tables):
    return rounded(A.group_mean(cars(t), "Year", "Automobile_Sales"), 4)


@query("mean_skips_missing", "A1", f"""
    WITH {GAPS} SELECT l_tax, round(avg(l_discount), 6) AS mean FROM gaps WHERE l_tax IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return rounded(A.group_mean(gaps(t), "l_tax", "l_discount", "mean"), 6, "mean")


@query("mean_by_keys", "A2", f"""
    WITH {CARS} SELECT "Year", "Vehicle_Type", round(avg("Automobile_Sales"), 4) AS sales
    FROM cars WHERE "Recession" = 1 GROUP BY ALL""")
def _(t: Tables):
    return rounded(A.group_mean(cars(t).filter("Recession = 1"), ["Year", "Vehicle_Type"], "Automobile_Sales", "sales"), 4)


@query("count_by_keys", "A3", f"""
    WITH {GAPS} SELECT l_returnflag, l_suppkey, count(l_discount) AS n FROM gaps GROUP BY ALL""")
def _(t: Tables):
    return A.group_count(gaps(t), ["l_returnflag", "l_suppkey"], "l_discount", "n")


@query("sum_by_key", "A4", f"""
    WITH {GAPS} SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_tax > 0.07 THEN l_discount END), 0), 4) AS total
    FROM gaps GROUP BY ALL""")
def _(t: Tables):
    df = gaps(t).withColumn("high", F.when(F.col("l_tax") > 0.07, F.col("l_discount")))
    return rounded(A.group_sum(df, "l_suppkey", "high", "total"), 4)


@query("totals_by_period", "A5", f"""
    WITH {CARS} SELECT round(sum(CASE WHEN "Recession" = 1 THEN "Advertising_Expenditure" END), 2) AS recession,
                       round(sum(CASE WHEN "Recession" = 0 THEN "Advertising_Expenditure" END), 2) AS otherwise
    FROM cars""")
def _(t: Tables):
    rec = F.col("Recession")
    return rounded(A.total_where(cars(t), {"recession": rec == 1, "otherwise": rec == 0}, "Advertising_Expenditure", 0.0), 2)


@query("total_of_nothing", "A5", """
    SELECT sum(CASE WHEN c_mktsegment = 'NASA' THEN c_acctbal END) AS total FROM customer""")
def _(t: Tables):
    return A.total_where(t.customer, {"total": F.col("c_mktsegment") == "NASA"}, "c_acctbal")


@query("mean_where", "A6", """
    SELECT round(avg(p_retailprice), 4) AS mean FROM part WHERE p_brand = 'Brand#11'""")
def _(t: Tables):
    return rounded(A.mean_where(t.part, F.col("p_brand") == "Brand#11", "p_retailprice", "mean"), 4)


@query("first_date_where", "A7", """
    SELECT min(l_shipdate) AS first FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09""")
def _(t: Tables):
    chosen = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09)
    return A.first_date_where(t.lineitem, chosen, "l_shipdate", "first")


@query("rows_by_group", "A8", f"""
    WITH {GAPS} SELECT l_discount, l_returnflag, count(*) AS n FROM gaps GROUP BY ALL""")
def _(t: Tables):
    return A.group_rows(gaps(t), ["l_discount", "l_returnflag"], "n")


@query("several_aggregates", "A9", f"""
    WITH {CARS} SELECT "Vehicle_Type", round(avg("Price"), 4) AS "Price", round(avg("Automobile_Sales"), 4) AS "Automobile_Sales",
           round(min("GDP"), 2) AS "GDP_min", round(max("GDP"), 2) AS "GDP_max"
    FROM cars WHERE "Recession" = 1 GROUP BY ALL""")
def _(t: Tables):
    rec = cars(t).filter("Recession = 1")
    return rounded(A.group_multi(rec, "Vehicle_Type", {"Price": "mean", "Automobile_Sales": "mean", "GDP": ["min", "max"]}), 4)


@query("value_counts", "A10", f"""
    WITH {GAPS} SELECT l_discount, count(*) AS n FROM gaps WHERE l_discount IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return A.value_counts(gaps(t), "l_discount", "n")


@query("value_shares", "A11 W3 H7", """
    SELECT o_orderstatus, round_even(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent FROM orders GROUP BY ALL""")
def _(t: Tables):
    return A.value_shares(t.orders, "o_orderstatus")


@query("share_of_total", "A12", f"""
    WITH {CARS}, sums AS (SELECT "Vehicle_Type", sum("Advertising_Expenditure") AS ads FROM cars WHERE "Recession" = 1 GROUP BY ALL)
    SELECT "Vehicle_Type", round(ads, 2) AS ads, round_even(ads * 100 / (SELECT sum(ads) FROM sums), 1) AS percent FROM sums""")
def _(t: Tables):
    df = cars(t).filter("Recession = 1").withColumnRenamed("Advertising_Expenditure", "ads")
    return rounded(A.share_of_total(df, "Vehicle_Type", "ads"), 2, "ads")


@query("share_of_means", "A12", f"""
    WITH {CLEAN_RIDES}, means AS (SELECT member_casual, avg(ride_length) AS m FROM clean GROUP BY ALL)
    SELECT member_casual, round(m, 4) AS m, round_even(m * 100 / (SELECT sum(m) FROM means), 1) AS percent FROM means""")
def _(t: Tables):
    means = A.group_mean(clean_rides(rides(t)), "member_casual", "ride_length", "m")
    return rounded(A.shares_of_rows(means, "m"), 4, "m")


@query("ranked_counts_between", "A13", """
    SELECT l_returnflag || l_linestatus AS outcome, count(*) AS n FROM lineitem
    WHERE l_shipdate::DATE >= DATE '1996-06-04' AND l_shipdate::DATE <= DATE '1999-03-20' GROUP BY ALL""")
def _(t: Tables):
    df = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("outcome"),
                           F.to_date("l_shipdate").alias("day"))
    return A.ranked_counts_between(df, "outcome", "day", datetime.date(1996, 6, 4), datetime.date(1999, 3, 20), "n")


@query("success_rate", "A20 P14", """
    SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END), 6) AS success_rate FROM lineitem""")
def _(t: Tables):
    labelled = t.lineitem.select(F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("class"))
    return rounded(A.success_rate(labelled, "class"), 6)


@query("pivot_means", "A21", f"""
    SELECT p_brand, {", ".join(f"round(avg(CASE WHEN p_type = '{k}' THEN p_retailprice END), 4) AS {k}" for k in TYPES)}
    FROM part GROUP BY ALL""")
def _(t: Tables):
    return rounded(A.pivot_mean(t.part, "p_brand", "p_type", "p_retailprice", TYPES), 4)


@query("distinct_values", "A28", "SELECT DISTINCT c_mktsegment FROM customer")
def _(t: Tables):
    return A.distinct_values(t.customer, "c_mktsegment")


@query("distinct_value_pairs", "A28 P9", """
    SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 4 AND p_size < 46""")
def _(t: Tables):
    return A.distinct_values(t.part.filter("p_size > 4 AND p_size < 46"), "p_brand", "p_type")


@query("mean_ride_length", "S1 P12 H8 P6 H5 A2 J4 O2", f"""
    WITH {CLEAN_RIDES}, means AS (SELECT member_casual, weekday, avg(ride_length) AS ride_length FROM clean GROUP BY ALL),
         levels AS (SELECT unnest(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']) AS weekday,
                           unnest(range(1, 8)) AS weekday_order)
    SELECT member_casual, weekday, weekday_order, round(ride_length, 4) AS ride_length
    FROM (SELECT DISTINCT member_casual FROM means) CROSS JOIN levels LEFT JOIN means USING (member_casual, weekday)""")
def _(t: Tables):
    from tallywork.plans.rides import mean_length_by_weekday

    return longs(rounded(mean_length_by_weekday(clean_rides(rides(t))), 4))
