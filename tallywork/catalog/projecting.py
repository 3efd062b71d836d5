"""Projections and filters."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallywork.catalog.inputs import GAPS, gaps
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators import columns as C
from tallywork.operators import filters as P
from tallywork.operators.numbering import renumber

_LINE_IDS = "l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber"


@query("select_columns", "P1", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def _(t: Tables):
    return C.select_columns(t.orders, ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("drop_columns", "P2", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    return C.drop_columns(t.customer, ["c_name", "c_nationkey"])


@query("derive_columns", "P3 H15 H7", f"""
    SELECT {_LINE_IDS}, l_quantity, l_extendedprice, l_quantity / 5 AS size,
           round_even((l_quantity + l_linenumber + l_suppkey + l_partkey) / 60, 2) AS hours
    FROM lineitem""")
def _(t: Tables):
    df = C.derive(t.lineitem, "size", "l_quantity / 5")
    total = F.col("l_quantity") + F.col("l_linenumber") + F.col("l_suppkey") + F.col("l_partkey")
    df = C.derive(df, "hours", F.bround(total / 60, 2))
    return longs(df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "size", "hours"))


@query("lowercase_columns", "P4 P18", """
    SELECT p_partkey AS partkey, p_brand AS brand, p_retailprice AS price FROM part""")
def _(t: Tables):
    upper = C.rename_columns(C.select_columns(t.part, ["p_partkey", "p_brand", "p_retailprice"]),
                             {"p_partkey": "PartKey", "p_brand": "BRAND", "p_retailprice": "Price"})
    return C.lowercase_columns(upper)


@query("clean_column_names", "P5", """
    SELECT s_suppkey AS supplier_key, s_acctbal AS account_balance, s_name AS account_balance_2 FROM supplier""")
def _(t: Tables):
    return C.clean_column_names(t.supplier.select(
        F.col("s_suppkey").alias("SupplierKey"), F.col("s_acctbal").alias("Account Balance"),
        F.col("s_name").alias("account.balance")))


@query("filter_compare", "P6", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000""")
def _(t: Tables):
    return P.filter_compare(t.orders, "o_totalprice", ">", 250000.0).select("o_orderkey", "o_totalprice")


@query("filter_number_range", "P7", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 200000""")
def _(t: Tables):
    kept = P.filter_between(t.orders, "o_totalprice", 100000.0, 200000.0, inclusive=False)
    return kept.select("o_orderkey", "o_totalprice")


@query("filter_date_range", "P7", """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate BETWEEN DATE '1996-06-04' AND DATE '1998-03-20'""")
def _(t: Tables):
    lo, hi = datetime.datetime(1996, 6, 4), datetime.datetime(1998, 3, 20)
    df = t.orders.select("o_orderkey", "o_orderdate")
    return df.filter(F.col("o_orderdate").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))


@query("filter_up_to_date", "P7 H3", """
    SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE <= DATE '1997-11-13'""")
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return P.filter_between(df, "day", hi=datetime.date(1997, 11, 13))


@query("filter_prefix", "P8", """
    SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'RED%'""")
def _(t: Tables):
    return P.filter_prefix(t.part, "p_name", "RED").select("p_partkey", "p_name")


@query("filter_prefix_exact_case", "P8", """
    SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'""")
def _(t: Tables):
    return P.filter_prefix(t.part, "p_name", "red", ignore_case=False).select("p_partkey", "p_name")


@query("filter_equals", "P9", """
    SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def _(t: Tables):
    return P.filter_equals(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("filter_not_equal_keep_null", "P10", f"""
    WITH {GAPS} SELECT {_LINE_IDS}, l_discount FROM gaps WHERE l_discount IS DISTINCT FROM 0.05""")
def _(t: Tables):
    kept = P.filter_not_equal_keep_null(gaps(t), "l_discount", 0.05)
    return longs(kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount"))


@query("filter_not_null", "P11", f"""
    WITH {GAPS} SELECT {_LINE_IDS}, l_tax FROM gaps WHERE l_tax IS NOT NULL""")
def _(t: Tables):
    kept = P.filter_not_null(gaps(t), "l_tax")
    return longs(kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax"))


@query("drop_incomplete_rows", "P12", f"""
    WITH {GAPS} SELECT {_LINE_IDS}, l_discount, l_tax FROM gaps
    WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def _(t: Tables):
    kept = P.drop_incomplete_rows(gaps(t))
    return longs(kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"))


@query("filter_list_size", "P13 H11", """
    SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1""")
def _(t: Tables):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    single = P.filter_array_size(lists, "parts", 1)
    return single.select("l_orderkey", F.try_element_at("parts", F.lit(1)).alias("part"))


@query("label_membership", "P14", """
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END::BIGINT AS label
    FROM orders""")
def _(t: Tables):
    labelled = C.label_membership(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"], "label")
    return longs(labelled.select("o_orderkey", "label"))


@query("cast_columns", "P15", """
    SELECT c_custkey, trunc(c_acctbal)::BIGINT AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer""")
def _(t: Tables):
    cast = C.cast_columns(t.customer, {"c_acctbal": "int", "c_nationkey": "double"})
    return longs(cast.select("c_custkey", "c_acctbal", "c_nationkey"))


@query("cast_dirty_text", "P15", """
    SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS number, TRY_CAST(p_brand AS BIGINT) AS bad
    FROM part""")
def _(t: Tables):
    df = t.part.select("p_partkey", F.substring("p_brand", 7, 10).alias("number"), F.col("p_brand").alias("bad"))
    return C.cast_columns(df, {"number": "long", "bad": "long"}, strict=False)


@query("recode_values", "P16", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 5 ELSE 3 END::BIGINT AS level
    FROM orders""")
def _(t: Tables):
    df = C.recode(t.orders, "o_orderstatus", {"F": "finished", "O": "open"}, "status")
    df = C.recode(df, "o_orderpriority", {"1-URGENT": 1, "5-LOW": 5}, "level", default=3)
    return longs(df.select("o_orderkey", "status", "level"))


@query("renumber_rows", "P17 W4", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS flight_number
    FROM orders WHERE o_orderstatus <> 'P'""")
def _(t: Tables):
    kept = t.orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderdate")
    return renumber(kept, ["o_orderdate", "o_orderkey"], "flight_number", unique=True).drop("o_orderdate")


@query("rename_results", "P18", """
    SELECT o_orderstatus AS rider, o_orderpriority AS bike, count(*) AS rides FROM orders GROUP BY ALL""")
def _(t: Tables):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").count()
    return C.rename_columns(counts, {"o_orderstatus": "rider", "o_orderpriority": "bike", "count": "rides"})


@query("nulls_for_nans", "H13 P6", """
    SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 6) END AS root FROM supplier""")
def _(t: Tables):
    # the root of a negative number is NaN
    return rounded(C.nulls_for_nans(t.supplier.select("s_suppkey", F.sqrt("s_acctbal").alias("root"))), 6)
