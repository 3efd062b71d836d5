"""Event monitoring, in batch and as streams, and activity by weekday and hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.inputs import LOG, log
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.catalog.reporting import DAILY, daily_activity
from tallywork.catalog.statistical import BOX
from tallywork.functions.dates import day_name
from tallywork.plans import fitness, network
from tallywork.session import scratch_path
from tallywork.streaming import monitor

def _day():
    return F.to_date("ts")


@query("attacks_per_day", "D1", f"""
    WITH {LOG} SELECT ts::DATE AS period, count(*) AS count, rank() OVER (ORDER BY count(*) DESC) AS rank
    FROM log WHERE attack_type = 'error' GROUP BY ALL""")
def _(t: Tables):
    return longs(network.counts_per_period(log(t), _day(), condition=F.col("attack_type") == "error"))


@query("peak_days", "D1", f"""
    WITH {LOG} SELECT ts::DATE AS period, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, ts::DATE) AS rank
    FROM log GROUP BY ts::DATE QUALIFY rank <= 3""")
def _(t: Tables):
    return longs(network.busiest_periods(log(t), _day(), 3))


@query("detection_per_day", "D2", f"""
    WITH {LOG} SELECT ts::DATE AS period, count_if(ioc_detected)::BIGINT AS detected,
                      count_if(NOT ioc_detected)::BIGINT AS not_detected FROM log GROUP BY ALL""")
def _(t: Tables):
    return network.detection_by_period(log(t), _day(), F.col("ioc_detected"))


@query("share_by_protocol", "D3", f"""
    WITH {LOG} SELECT protocol, round_even(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent FROM log GROUP BY ALL""")
def _(t: Tables):
    return network.shares_by(log(t), "protocol")


@query("share_by_attack_type", "D4", f"""
    WITH {LOG} SELECT attack_type, round_even(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent FROM log GROUP BY ALL""")
def _(t: Tables):
    return network.shares_by(log(t), "attack_type")


@query("attempts_by_transport", "D5", f"""
    WITH {LOG} SELECT transport, count(*) AS attempts FROM log GROUP BY ALL""")
def _(t: Tables):
    return network.attempts_by_transport(log(t), "transport")


@query("packet_length_summary", "D6", f"""
    WITH {LOG}, {BOX.format(g="attack_type", v="packet_length", t="log")}
    SELECT attack_type, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
           round(any_value(q3), 4) AS q3, min(CASE WHEN NOT beyond THEN packet_length END) AS low_whisker,
           max(CASE WHEN NOT beyond THEN packet_length END) AS high_whisker, count_if(beyond)::BIGINT AS outliers
    FROM fenced GROUP BY attack_type""")
def _(t: Tables):
    return rounded(network.packet_length_summary(log(t), "attack_type", "packet_length"), 4)


@query("packet_length_histogram", "D6", f"""
    WITH {LOG} SELECT attack_type, floor(packet_length / 10)::BIGINT AS bin, (floor(packet_length / 10) * 10)::DOUBLE AS bin_start,
                      count(*) AS count FROM log GROUP BY ALL""")
def _(t: Tables):
    return network.packet_length_histogram(log(t), "attack_type", "packet_length", 10.0)


@query("traffic_spikes", "D7", f"""
    WITH {LOG}, c AS (SELECT attack_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS count FROM log GROUP BY ALL),
    n AS (SELECT date_diff('hour', min(bucket), max(bucket)) + 1 AS buckets FROM c),
    s AS (SELECT attack_type, sum(count) / any_value(buckets) AS mean,
                 sqrt(greatest(sum(count * count) / any_value(buckets) - pow(sum(count) / any_value(buckets), 2), 0)) AS deviation
          FROM c CROSS JOIN n GROUP BY ALL)
    SELECT attack_type, bucket, count, round(mean, 4) AS mean, round(deviation, 4) AS deviation,
           round((count - mean) / nullif(deviation, 0), 4) AS z
    FROM c JOIN s USING (attack_type) WHERE (count - mean) / nullif(deviation, 0) > 1.5""")
def _(t: Tables):
    return rounded(network.traffic_spikes(log(t), "ts", "attack_type", "1 hour", 1.5), 4)


@query("credential_stuffing", "D8", f"""
    WITH {LOG}, w AS (
        SELECT unnest(range(6)) AS i, time_bucket(INTERVAL 1 HOUR, ts) AS hour, account, packet_length FROM log)
    SELECT hour - i * INTERVAL 1 HOUR AS window_start, hour + (6 - i) * INTERVAL 1 HOUR AS window_end, account,
           count(*) AS attempts, count(DISTINCT packet_length) AS sources
    FROM w GROUP BY ALL HAVING count(*) >= 4 AND count(DISTINCT packet_length) >= 3""")
def _(t: Tables):
    return network.credential_stuffing(log(t), "ts", "account", "packet_length", "6 hours", "1 hour", 4, 3)


@query("unusual_access", "D9", f"""
    WITH {LOG}, c AS (SELECT account, protocol || transport AS resource, count(*) AS count FROM log GROUP BY ALL),
    s AS (SELECT account, avg(count) AS mean, stddev_pop(count) AS deviation FROM c GROUP BY ALL)
    SELECT account, resource, count, round(mean, 4) AS mean, round(deviation, 4) AS deviation,
           round((count - mean) / nullif(deviation, 0), 4) AS z
    FROM c JOIN s USING (account) WHERE (count - mean) / nullif(deviation, 0) > 1.3""")
def _(t: Tables):
    df = log(t).withColumn("resource", F.concat("protocol", "transport"))
    return rounded(network.unusual_access(df, "account", "resource", 1.3), 4)


@query("monthly_trend", "D10", """
    WITH c AS (SELECT o_orderstatus, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, count(*) AS n FROM orders GROUP BY ALL),
    f AS (SELECT o_orderstatus, regr_slope(n, t) AS slope, regr_intercept(n, t) AS intercept, max(t) + 1 AS next_period
          FROM c GROUP BY ALL)
    SELECT o_orderstatus, round(slope, 6) AS slope, round(intercept, 3) AS intercept, next_period,
           round(intercept + slope * next_period, 3) AS next_count FROM f""")
def _(t: Tables):
    trend = network.monthly_trend(t.orders, "o_orderdate", ["o_orderstatus"])
    return longs(rounded(rounded(trend, 6, "slope"), 3, "intercept", "next_count"))


_MINUTES = [c.replace("minutes", "") for c in fitness.MINUTE_COLUMNS]


@query("minutes_by_weekday_and_type", "D12", f"""
    WITH {DAILY}, long AS ({" UNION ALL ".join(
        f"SELECT day, '{c}' AS activity_type, {c} AS minutes FROM daily" for c in fitness.MINUTE_COLUMNS)})
    SELECT dayname(day) AS day_of_week, (dayofweek(day) + 6) % 7 + 1 AS day_of_week_order, activity_type,
           round(avg(minutes), 4) AS mean_minutes FROM long GROUP BY ALL""")
def _(t: Tables):
    df = fitness.clean_daily_activity(daily_activity(t)).drop("day_of_week_order")
    return longs(rounded(fitness.minutes_by_weekday_and_type(df, fitness.MINUTE_COLUMNS), 4))


@query("steps_by_weekday", "D13", f"""
    WITH {DAILY} SELECT dayname(day) AS day_of_week, (dayofweek(day) + 6) % 7 + 1 AS day_of_week_order,
                        round(avg(totalsteps), 4) AS totalsteps FROM daily GROUP BY ALL""")
def _(t: Tables):
    df = fitness.clean_daily_activity(daily_activity(t)).drop("day_of_week_order")
    return longs(rounded(fitness.steps_by_weekday(df, "totalsteps"), 4))


@query("most_active_hours", "D14", """
    SELECT hour(ts) AS hour, round(avg(value), 4) AS value, row_number() OVER (ORDER BY avg(value) DESC, hour(ts)) AS rank
    FROM events GROUP BY hour(ts) QUALIFY rank <= 5""")
def _(t: Tables):
    return longs(rounded(fitness.top_hours(t.events, "ts", "value", 5), 4))


@query("value_by_weekday_and_hour", "D13 D14", """
    SELECT dayname(ts) AS weekday, hour(ts) AS hour, round(avg(value), 4) AS value FROM events GROUP BY ALL""")
def _(t: Tables):
    df = t.events.withColumn("weekday", day_name(F.col("ts"))).withColumn("hour", F.hour("ts"))
    return longs(rounded(df.groupBy("weekday", "hour").agg(F.avg("value").alias("value")), 4))


def _event_stream(t: Tables):
    return monitor.read_event_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")


def _zone_free(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


# A stream gives out a window once the watermark, the latest time less the allowed delay, has passed it.
@query("stream_tumbling_counts", "D11 D1", """
    WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS count FROM events GROUP BY ALL)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count FROM w
    WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _(t: Tables):
    counts = monitor.tumbling_counts(_event_stream(t), "ts", "event_type", "1 hour", "2 hours")
    return _zone_free(monitor.run_available(counts, "tumbling"))


@query("stream_suspects", "D11 D8", """
    WITH steps AS (SELECT unnest(range(6)) AS i, time_bucket(INTERVAL 1 HOUR, ts) AS hour, user_id, event_type FROM events),
    w AS (SELECT hour - i * INTERVAL 1 HOUR AS window_start, user_id, count(*) AS attempts, count(DISTINCT event_type) AS sources
          FROM steps GROUP BY ALL)
    SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, user_id, attempts, sources FROM w
    WHERE attempts >= 4 AND sources >= 3 AND window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _(t: Tables):
    suspects = monitor.sliding_suspects(_event_stream(t), "ts", "user_id", "event_type", "6 hours", "1 hour",
                                        "2 hours", min_attempts=4, min_sources=3)
    return _zone_free(monitor.run_available(suspects, "suspects"))


# Two arrivals, each run to its end and stopped; the second goes on from the checkpoint. The last buckets stay open.
@query("stream_spikes", "D11 D7", """
    WITH c AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS count FROM events GROUP BY ALL),
    g AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM c GROUP BY event_type),
    s AS (SELECT event_type, bucket, coalesce(count, 0) AS count, count(*) OVER before AS n, avg(coalesce(count, 0)) OVER before AS mean,
                 sqrt(greatest(avg(coalesce(count, 0) * coalesce(count, 0)) OVER before - pow(avg(coalesce(count, 0)) OVER before, 2), 0)) AS deviation
          FROM g LEFT JOIN c USING (event_type, bucket)
          WINDOW before AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_type, bucket, count, round(mean, 4) AS mean, round(deviation, 4) AS deviation, round((count - mean) / nullif(deviation, 0), 4) AS z
    FROM s WHERE n >= 24 AND count > 0 AND (count - mean) / nullif(deviation, 0) > 2
      AND bucket + INTERVAL 2 HOUR <= (SELECT max(bucket) FROM c)""")
def _(t: Tables):
    arrived, progress = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "spikes")
    day = F.dayofmonth("ts")
    for part in (day <= 15, day > 15):
        t.events.filter(part).write.mode("append").parquet(arrived)
        events = monitor.read_event_stream(t.spark, arrived, t.events.schema)
        found = monitor.run_available(monitor.spikes(events, "ts", "event_type", "1 hour", "2 hours", k=2.0), "spikes", progress)
    return rounded(_zone_free(found), 4)


@query("stream_deduplicated", "D11 A16", "SELECT event_id, ts, event_type FROM events")
def _(t: Tables):
    stream = _event_stream(t).select("event_id", "ts", "event_type")
    unique = monitor.deduplicate(stream.union(stream), "event_id", "ts", "1 day")
    return _zone_free(monitor.run_available(unique, "unique"))
