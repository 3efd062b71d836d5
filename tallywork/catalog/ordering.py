"""Sorts, first and last rows, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.inputs import GAPS, gaps
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.functions.dates import WEEKDAYS_FROM_MONDAY, day_name
from tallywork.operators import ordering as O
from tallywork.operators.aggregates import group_mean
from tallywork.operators.numbering import renumber


@query("sort_missing_last", "O1", f"""
    WITH {GAPS} SELECT l_discount, n, row_number() OVER (ORDER BY l_discount NULLS LAST) AS position
    FROM (SELECT l_discount, count(*) AS n FROM gaps GROUP BY ALL)""")
def _(t: Tables):
    counts = gaps(t).groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    return renumber(O.sort(counts, "l_discount"), [F.asc_nulls_last("l_discount")], "position")


@query("sorted_rows", "O1", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_extendedprice FROM lineitem""")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return longs(O.sort(df, ["l_extendedprice", "l_orderkey"], descending=True))


@query("sort_by_levels", "O2", """
    SELECT dayname(ts) AS weekday, round(avg(value), 4) AS value, (dayofweek(ts) + 6) % 7 + 1 AS weekday_order
    FROM events GROUP BY ALL""")
def _(t: Tables):
    means = group_mean(t.events.withColumn("weekday", day_name(F.col("ts"))), "weekday", "value")
    return longs(rounded(O.sort_by_levels(means, "weekday", WEEKDAYS_FROM_MONDAY), 4))


@query("first_rows", "O3", """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders
    QUALIFY rank <= 10""")
def _(t: Tables):
    return longs(O.head(t.orders.select("o_orderkey", "o_totalprice"), 10, ["o_totalprice", "o_orderkey"], "rank"))


@query("last_rows", "O4", """
    SELECT o_orderkey, o_orderdate, 11 - row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
    FROM orders QUALIFY rank >= 1""")
def _(t: Tables):
    return longs(O.tail(t.orders.select("o_orderkey", "o_orderdate"), 10, ["o_orderdate", "o_orderkey"], "rank"))


@query("grouped_and_sorted", "O5", """
    SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, round(avg(c_acctbal), 4) AS c_acctbal FROM customer
    GROUP BY ALL""")
def _(t: Tables):
    keys = ["c_mktsegment", "c_nationkey"]
    return longs(rounded(O.sort(group_mean(t.customer, keys, "c_acctbal"), keys), 4))


@query("rank_by_count", "W1", """
    SELECT l_suppkey, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) - 1 AS rank
    FROM lineitem GROUP BY l_suppkey""")
def _(t: Tables):
    return O.rank_by_count(t.lineitem, "l_suppkey")


@query("values_at_ranks", "W2", """
    SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS rank, p_brand FROM part GROUP BY p_brand
    QUALIFY rank IN (1, 3, 5, 6, 7)""")
def _(t: Tables):
    return longs(O.values_at_ranks(t.part, "p_brand", [1, 3, 5, 6, 7]))
