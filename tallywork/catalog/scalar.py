"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.inputs import RIDES, rides
from tallywork.catalog.registry import Tables, longs, query
from tallywork.functions import dates as D
from tallywork.functions import scalars as S


@query("parse_iso_timestamp", "H1", """
    SELECT event_id, ts AS parsed, ts::DATE AS day FROM events""")
def _(t: Tables):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    parsed = D.parse_timestamp(text)
    return t.events.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"), D.day_of(parsed).alias("day"))


@query("parse_american_dates", "H2", """
    SELECT event_id, date_trunc('second', ts) AS parsed,
           CASE WHEN event_type <> 'error' THEN ts::DATE END AS day
    FROM events""")
def _(t: Tables):
    full = F.date_format("ts", "M/d/yyyy h:mm:ss a")
    short = F.when(F.col("event_type") == "error", F.lit("no date")).otherwise(F.date_format("ts", "M/d/yyyy"))
    return t.events.select(
        "event_id", D.parse_month_day_year_time(full).cast("timestamp_ntz").alias("parsed"),
        D.parse_month_day_year(short).alias("day"))


@query("calendar_fields", "H3 H4 H5", """
    SELECT o_orderkey, dayname(o_orderdate) AS weekday, day(o_orderdate) AS day, month(o_orderdate) AS month,
           monthname(o_orderdate) AS month_name, year(o_orderdate) AS year
    FROM orders""")
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderdate")
    return longs(df.withColumns(D.calendar_columns(F.col("o_orderdate"))).drop("o_orderdate"))


@query("weekday_number", "H6", """
    SELECT o_orderkey, dayofweek(o_orderdate) + 1 AS weekday FROM orders""")
def _(t: Tables):
    return longs(t.orders.select("o_orderkey", D.weekday_number(F.col("o_orderdate")).alias("weekday")))


@query("round_half_even", "H7", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey,
           round_even(l_quantity / 2, 0) AS halves, round_even(l_quantity / 20, 1) AS twentieths
    FROM lineitem""")
def _(t: Tables):
    quantity = F.col("l_quantity")
    return longs(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.round_half_even(quantity / 2).alias("halves"),
        S.round_half_even(quantity / 20, 1).alias("twentieths")))


@query("elapsed_minutes", "H8", f"""
    WITH {RIDES}, spans AS (
        SELECT member_casual, epoch_us(ended_at) - epoch_us(started_at) AS us FROM rides)
    SELECT member_casual, count(*) AS rides, sum(trunc(us / 60e6))::BIGINT AS whole,
           round(sum(us / 60e6), 1) AS minutes
    FROM spans GROUP BY ALL""")
def _(t: Tables):
    start, end = F.col("started_at"), F.col("ended_at")
    return rides(t).groupBy("member_casual").agg(
        F.count(F.lit(1)).alias("rides"), F.sum(D.whole_minutes(start, end)).alias("whole"),
        F.round(F.sum(D.elapsed_minutes(start, end)), 1).alias("minutes"))


@query("elapsed_fractions", "H8", """
    SELECT event_id, trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00.5')) / 60e6)::BIGINT AS minutes
    FROM events""")
def _(t: Tables):
    noon = F.lit("2024-01-15 12:00:00.5").cast("timestamp_ntz")
    return longs(t.events.select("event_id", D.whole_minutes(noon, F.col("ts")).alias("minutes")))


@query("text_slices", "H9", """
    SELECT o_orderkey, substr(o_orderdate::DATE::VARCHAR, 6, 2) AS month,
           substr(o_orderdate::DATE::VARCHAR, 1, 4) AS year, substr(o_orderdate::DATE::VARCHAR, 1, 3) AS from_zero
    FROM orders""")
def _(t: Tables):
    text = F.to_date("o_orderdate").cast("string")
    return t.orders.select("o_orderkey", S.text_slice(text, 6, 2).alias("month"),
                           S.text_slice(text, 1, 4).alias("year"), S.text_slice(text, 0, 4).alias("from_zero"))


@query("flag_and_text", "H10", """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN 'None' WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END
           || ' ' || CASE WHEN o_orderpriority = '5-LOW' THEN 'None' ELSE o_orderpriority END AS outcome
    FROM orders""")
def _(t: Tables):
    flag = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 200000)
    text = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return t.orders.select("o_orderkey", S.flag_and_text(flag, text).alias("outcome"))


@query("list_length_and_first", "H11", """
    SELECT vec_id, len(embedding) AS length, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings""")
def _(t: Tables):
    items = F.col("embedding")
    return longs(t.embeddings.select(
        "vec_id", S.list_length(items).alias("length"), F.round(S.first_item(items).cast("double"), 6).alias("first")))


@query("struct_fields", "H12", """
    SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders""")
def _(t: Tables):
    packed = t.orders.select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("core"))
    return packed.select("o_orderkey", F.col("core.o_orderstatus").alias("status"),
                         F.col("core.o_totalprice").alias("price"))


@query("fill_constant", "H13", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, coalesce(nullif(l_discount, 0), -1) AS discount
    FROM lineitem""")
def _(t: Tables):
    missing = F.nullif(F.col("l_discount"), F.lit(0.0))
    return longs(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                                   S.fill_constant(missing, -1.0).alias("discount")))


@query("json_fields", "H14", """
    SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.absent' AS absent FROM events""")
def _(t: Tables):
    return t.events.select("event_id", S.json_field(F.col("props"), "$.k", "long").alias("k"),
                           S.json_field(F.col("props"), "$.absent").alias("absent"))


@query("json_fields_of_one_parse", "H14", """
    SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS k_text, props->>'$.absent' AS absent FROM events""")
def _(t: Tables):
    return S.with_json_fields(t.events.select("event_id", "props"), "props", {
        "k": ("$.k", "long"), "k_text": ("$.k", "string"), "absent": ("$.absent", "string")}).drop("props")


@query("safe_ratio", "H15", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey,
           round(l_tax / nullif(l_discount, 0), 6) AS ratio
    FROM lineitem""")
def _(t: Tables):
    return longs(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                                   F.round(S.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio")))
