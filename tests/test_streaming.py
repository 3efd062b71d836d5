import datetime

from conftest import rows, ts
from tallywork.session import scratch_path
from tallywork.streaming import monitor

SCHEMA = "id int, ts timestamp_ntz, kind string, account string, source string"


def at(minutes):
    return ts("2024-01-01 00:00:00") + datetime.timedelta(minutes=minutes)


def arrive(spark, path, data):
    df = spark.createDataFrame(data, SCHEMA.replace("timestamp_ntz", "timestamp"))
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return monitor.read_event_stream(spark, path, SCHEMA)


def run_again(df, path):
    query = (df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def test_windows_close_once_and_late_events_are_dropped(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    arrive(spark, path, [(1, at(1), "a", "u", "s"), (2, at(2), "a", "u", "s"), (3, at(31), "a", "u", "s")])
    counts = monitor.tumbling_counts(stream(spark, path), "ts", "kind", "10 minutes", "10 minutes")
    assert rows(run_again(counts, out)) == [(at(0), at(10), "a", 2)]
    # an event behind the watermark is dropped, one before it in order still counts
    arrive(spark, path, [(4, at(3), "a", "u", "s"), (5, at(29), "b", "u", "s"), (6, at(90), "a", "u", "s")])
    counts = monitor.tumbling_counts(stream(spark, path), "ts", "kind", "10 minutes", "10 minutes")
    assert rows(run_again(counts, out)) == [
        (at(0), at(10), "a", 2), (at(20), at(30), "b", 1), (at(30), at(40), "a", 1)]


def test_duplicates_across_batches(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    arrive(spark, path, [(1, at(1), "a", "u", "s"), (1, at(1), "a", "u", "s"), (2, at(2), "a", "u", "s")])
    unique = monitor.deduplicate(stream(spark, path), "id", "ts", "1 hour").select("id")
    assert rows(run_again(unique, out)) == [(1,), (2,)]
    arrive(spark, path, [(2, at(3), "a", "u", "s"), (3, at(4), "a", "u", "s")])
    unique = monitor.deduplicate(stream(spark, path), "id", "ts", "1 hour").select("id")
    assert rows(run_again(unique, out)) == [(1,), (2,), (3,)]


def test_suspects(spark):
    path = scratch_path(spark, "in")
    arrive(spark, path, [(i, at(8 + i), "a", "victim", f"s{i}") for i in range(5)]
           + [(20 + i, at(i), "a", "typist", "home") for i in range(9)] + [(99, at(300), "a", "x", "y")])
    suspects = monitor.sliding_suspects(stream(spark, path), "ts", "account", "source", "10 minutes", "5 minutes", "10 minutes", 4, 3)
    assert rows(monitor.run_available(suspects, "suspects")) == [(at(5), at(15), "victim", 5, 5)]


def plain_spikes(arrivals, width, delay, k, min_history, forget_after):
    """Spikes by replaying the arrivals: what closes after each, and what comes too late for it."""
    found, past, is_open, watermark, latest = [], {}, {}, None, None
    for rows_of in arrivals:
        for minute, key in rows_of:
            bucket = minute // width * width
            latest = bucket + width if latest is None else max(latest, bucket + width)
            if watermark is None or bucket + width > watermark:
                is_open[key, bucket] = is_open.get((key, bucket), 0) + 1
        watermark = latest - delay
        for key, bucket in sorted((x for x in is_open if x[1] + width <= watermark), key=lambda x: x[1]):
            count = is_open.pop((key, bucket))
            before = past.setdefault(key, [])
            if before and (bucket - before[-1][0]) // width > forget_after:
                before.clear()
            if before:
                counts = dict(before)
                line = [counts.get(b, 0) for b in range(before[0][0], bucket, width)]
                mean = sum(line) / len(line)
                deviation = max(sum(x * x for x in line) / len(line) - mean * mean, 0) ** 0.5
                if len(line) >= min_history and deviation > 0 and (count - mean) / deviation > k:
                    found.append((key, at(bucket), count, round(mean, 6), round(deviation, 6)))
            before.append((bucket, count))
    return sorted(found, key=str)


def test_spikes_over_arrivals_restarts_and_late_rows(spark):
    import random

    rng = random.Random(4)
    calm = [[(10 * b + rng.randrange(10), key) for b in range(start, start + 20) for key in ("a", "b") for _ in range(rng.choice([0, 1, 2, 3]))]
            for start in (0, 20, 40, 60)]
    calm[1] += [(255, "a")] * 9 + [(256, None)] * 2 + [(5, "a")] * 30  # a spike, a missing key, and rows of a bucket closed long ago
    calm[2] += [(395, "b")] * 9  # behind the arrival before, but its bucket is still open
    calm[3] = [r for r in calm[3] if r[1] == "b"] + [(1990, "b")] + [(1600 + 10 * b, "a") for b in range(12) for _ in range(1 + b % 2)] + [(1725, "a")] * 9
    calm.append([(2100, "b")])
    path, out, want = scratch_path(spark, "in"), scratch_path(spark, "out"), plain_spikes(calm, 10, 20, 1.5, 5, 60)
    for part in calm:
        arrive(spark, path, [(i, at(minute), key, "u", "s") for i, (minute, key) in enumerate(part)])
        found = monitor.spikes(stream(spark, path), "ts", "kind", "10 minutes", "20 minutes", 1.5, 5, 60)
        table = monitor.run_available(found, "spikes", out)  # a query of its own, from the checkpoint of the one before
    got = [(r["kind"], r["bucket"], r["count"], round(r["mean"], 6), round(r["deviation"], 6)) for r in table.collect()]
    assert sorted(got, key=str) == want and {("a", at(250)), ("a", at(1720))} <= {g[:2] for g in got}


def test_spikes_of_nothing(spark):
    path = scratch_path(spark, "in")
    arrive(spark, path, [(1, None, "a", "u", "s")])
    assert monitor.run_available(monitor.spikes(stream(spark, path), "ts", "kind", "10 minutes", "20 minutes"), "spikes").count() == 0
