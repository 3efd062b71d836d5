"""Merges, lookups, completion and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.inputs import HOURLY, hourly
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.functions.dates import WEEKDAYS_FROM_SUNDAY, day_name
from tallywork.operators.aggregates import group_mean
from tallywork.operators.joins import (
    complete_categories, enrich, merge_all, merge_inner, merge_stored, rows_at_extreme, store_for_merges,
)
from tallywork.operators.sets import drop_duplicate_rows, union_all
from tallywork.session import scratch_path


@query("merge_two_tables", "J1", f"""
    WITH {HOURLY} SELECT "Id", hour, steps, round(calories, 2) AS calories
    FROM steps JOIN calories USING ("Id", hour)""")
def _(t: Tables):
    steps, calories, _ = hourly(t)
    return rounded(merge_inner(steps, calories, ["Id", "hour"]), 2)


@query("merge_with_missing_keys", "J1", """
    WITH a AS (SELECT nullif(c_nationkey, 3)::BIGINT AS k, c_mktsegment AS seg, count(*) AS n, sum(c_acctbal) AS bal
               FROM customer GROUP BY ALL),
         b AS (SELECT nullif(s_nationkey, 3)::BIGINT AS k, count(*) AS n FROM supplier GROUP BY ALL)
    SELECT a.k, seg, round(bal, 2) AS bal, a.n AS n_x, b.n AS n_y FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def _(t: Tables):
    def missing(col: str):
        return F.nullif(F.col(col), F.lit(3)).cast("long").alias("k")

    a = t.customer.groupBy(missing("c_nationkey"), F.col("c_mktsegment").alias("seg")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("bal"))
    b = t.supplier.groupBy(missing("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(merge_inner(a, b, ["k"]), 2)


@query("merge_with_hot_key", "J1", """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey,
                      CASE WHEN l_returnflag = 'A' THEN -1 ELSE l_suppkey END AS k FROM lineitem),
         b AS (SELECT s_suppkey AS k, s_acctbal FROM supplier UNION ALL SELECT -1, 0.5)
    SELECT k, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM a JOIN b USING (k) GROUP BY k""")
def _(t: Tables):
    # one key holds a third of all rows: its rows are spread before the join
    a = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "A", F.lit(-1)).otherwise(F.col("l_suppkey")).alias("k"))
    hot = t.supplier.agg(F.lit(-1).cast("long").alias("k"), F.lit(0.5).alias("s_acctbal"))
    b = union_all([t.supplier.select(F.col("s_suppkey").alias("k"), "s_acctbal"), hot])
    joined = merge_inner(a, b, ["k"], na_matches=False, hot_share=0.1)
    return rounded(joined.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("bal")), 2)


@query("merge_three_tables", "J2", f"""
    WITH {HOURLY} SELECT "Id", hour, steps, round(calories, 2) AS calories, intensity
    FROM steps JOIN calories USING ("Id", hour) JOIN intensities USING ("Id", hour)""")
def _(t: Tables):
    return rounded(merge_all(hourly(t), ["Id", "hour"]), 2, "calories")


@query("merge_stored_tables", "J2", """
    WITH a AS (SELECT CASE WHEN l_returnflag = 'A' THEN -1 ELSE nullif(l_suppkey, 5) END AS k, l_quantity FROM lineitem),
         b AS (SELECT nullif(s_suppkey, 5) AS k, s_acctbal FROM supplier UNION ALL SELECT -1, 0.5),
         c AS (SELECT nullif(ps, 5) AS k, parts
               FROM (SELECT l_suppkey AS ps, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL)
               UNION ALL SELECT -1, 1)
    SELECT a.k, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(s_acctbal), 2) AS bal,
           sum(parts)::BIGINT AS parts
    FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k JOIN c ON a.k IS NOT DISTINCT FROM c.k GROUP BY a.k""")
def _(t: Tables):
    # dealt by key once, then merged bucket by bucket; the key of a third of the rows and the missing one lie apart
    def key(col: str):
        return F.nullif(F.col(col), F.lit(5)).cast("long")

    hot = t.supplier.agg(F.lit(-1).cast("long").alias("k"), F.lit(0.5).alias("s_acctbal"), F.lit(1).cast("long").alias("parts"))
    parts = t.lineitem.groupBy(key("l_suppkey").alias("k")).agg(F.countDistinct("l_partkey").alias("parts"))
    frames = {
        "merge_lines": t.lineitem.select(
            F.when(F.col("l_returnflag") == "A", F.lit(-1)).otherwise(key("l_suppkey")).alias("k"), "l_quantity"),
        "merge_suppliers": union_all([t.supplier.select(key("s_suppkey").alias("k"), "s_acctbal"), hot.drop("parts")]),
        "merge_parts": union_all([parts, hot.drop("s_acctbal")])}
    store_for_merges(frames, ["k"], 16, hot_share=0.1, folder=scratch_path(t.spark, "merges"))
    merged = merge_stored(t.spark, list(frames), ["k"])
    return rounded(merged.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("s_acctbal").alias("bal"),
        F.sum("parts").alias("parts")), 2)


@query("enrich_from_dimensions", "J3", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, p_brand AS booster, p_retailprice AS price,
           s_name AS pad, n_name AS country, r_name AS area
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = enrich(df, t.part, "l_partkey", "p_partkey", {"p_brand": "booster", "p_retailprice": "price"})
    df = enrich(df, t.supplier, "l_suppkey", "s_suppkey", {"s_name": "pad", "s_nationkey": "nation"})
    df = enrich(df, t.nation, "nation", "n_nationkey", {"n_name": "country", "n_regionkey": "region"})
    df = enrich(df, t.region, "region", "r_regionkey", {"r_name": "area"})
    return longs(df.drop("l_suppkey", "nation", "region"))


@query("complete_categories", "J4", """
    WITH means AS (SELECT p_brand, p_type, avg(p_retailprice) AS price FROM part GROUP BY ALL),
         levels AS (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'LUXURY']) AS p_type)
    SELECT p_brand, p_type, round(price, 4) AS price
    FROM (SELECT DISTINCT p_brand FROM means) CROSS JOIN levels LEFT JOIN means USING (p_brand, p_type)""")
def _(t: Tables):
    levels = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "LUXURY"]
    means = group_mean(t.part, ["p_brand", "p_type"], "p_retailprice", "price")
    return rounded(complete_categories(means, ["p_brand"], "p_type", levels), 4)


@query("rows_at_maximum", "J5", """
    SELECT DISTINCT p_brand FROM part WHERE p_size = (SELECT max(p_size) FROM part)""")
def _(t: Tables):
    return rows_at_extreme(t.part, "p_size", "max", ["p_brand"])


@query("rows_at_minimum", "J5", """
    SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem
    WHERE l_shipdate = (SELECT min(l_shipdate) FROM lineitem)""")
def _(t: Tables):
    return rows_at_extreme(t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate"), "l_shipdate", "min")


@query("union_tables", "U1", """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey::BIGINT AS nation FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def _(t: Tables):
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                                  F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
                                  F.col("s_name").alias("name"))
    return longs(union_all([customers, suppliers]))


@query("drop_duplicate_rows", "U2", """
    SELECT DISTINCT l_suppkey, l_returnflag, nullif(l_discount, 0) AS discount FROM lineitem""")
def _(t: Tables):
    return drop_duplicate_rows(t.lineitem.select(
        "l_suppkey", "l_returnflag", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount")))


@query("weekday_means_completed", "J4 O2 A2", """
    WITH levels AS (SELECT unnest(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']) AS weekday),
         means AS (SELECT user_id, event_type, dayname(ts) AS weekday, avg(value) AS value FROM events GROUP BY ALL)
    SELECT user_id, event_type, weekday, round(value, 8) AS value
    FROM (SELECT DISTINCT user_id, event_type FROM means) CROSS JOIN levels
    LEFT JOIN means USING (user_id, event_type, weekday)""")
def _(t: Tables):
    keys = ["user_id", "event_type"]
    means = group_mean(t.events.withColumn("weekday", day_name(F.col("ts"))), [*keys, "weekday"], "value")
    return rounded(complete_categories(means, keys, "weekday", WEEKDAYS_FROM_SUNDAY), 8)
