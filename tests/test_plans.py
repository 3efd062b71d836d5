import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import day, rows, ts
from tallywork import schemas
from tallywork.plans import cars, fitness, launches, network, rides
from tallywork.sources.tables import read_json_records, read_table


# --- rides -----------------------------------------------------------------------------------

def ride(i, start, end, rider="member", bike="classic_bike"):
    return (i, bike, ts(f"2023-{start}") if start else None, ts(f"2023-{end}") if end else None, rider)


RIDES = [
    ride("r1", "01-01 10:00:00", "01-01 10:10:30"),            # Sunday, 10 minutes
    ride("r2", "01-01 11:00:00", "01-01 11:20:00"),            # Sunday, 20 minutes
    ride("r3", "01-02 11:00:00", "01-02 11:00:30"),            # half a minute: dropped
    ride("r4", "01-02 11:00:00", "01-02 10:30:00"),            # ends before it starts: dropped
    ride("r5", "02-07 08:00:00", "02-07 08:01:00", "casual", "electric_bike"),  # Tuesday, exactly a minute
    ride("r6", None, "02-07 08:01:00", "casual"),              # incomplete: dropped
    ride("r7", "02-07 09:00:00", "02-07 09:05:00", "guest", "tandem"),
]


@pytest.mark.parametrize("staged", [True, False])
def test_ride_report(spark, staged):
    clean = rides.clean_rides(spark.createDataFrame(RIDES, schemas.RIDES))
    assert rows(clean.select("ride_id", "ride_length")) == [("r1", 10), ("r2", 20), ("r5", 1), ("r7", 5)]
    report = rides.ride_usage_report(clean, staged)
    assert rows(report["rider_share"], True) == [("member", 50.0), ("casual", 25.0), ("guest", 25.0)]
    assert rows(report["length_by_rider"]) == [("casual", 1.0), ("guest", 5.0), ("member", 15.0)]
    by_day = rows(report["length_by_weekday"], True)
    assert len(by_day) == 21 and by_day[:3] == [
        ("casual", "Sunday", None, 1), ("guest", "Sunday", None, 1), ("member", "Sunday", 15.0, 1)]
    assert rows(report["rides_by_bike"]) == [("casual", "electric_bike", 1), ("guest", "tandem", 1), ("member", "classic_bike", 2)]
    assert rows(report["length_by_month"]) == [
        ("casual", 2, "February", 1.0), ("guest", 2, "February", 5.0), ("member", 1, "January", 15.0)]
    labelled = rides.labelled(report)
    assert rows(labelled["rides_by_bike"].select("member_casual_label", "rideable_type_label")) == [
        (None, None), ("會員", "普通自行車"), ("臨時使用者", "電動輔助自行車")]
    cross = {r[0]: tuple(r)[1:3] for r in rides.length_by_rider_and_month(report["length_by_month"]).collect()}
    assert cross == {"member": (15.0, None), "casual": (None, 1.0), "guest": (None, 5.0)}


def test_ride_report_kept_up(spark, tmp_path):
    from tallywork.streaming.kept_sums import store_arrival, stored_sums

    folder, arrivals, checkpoint = (str(tmp_path / name) for name in ("sums", "in", "checkpoint"))
    given = spark.createDataFrame(RIDES, schemas.RIDES)

    def arrive(*ids):
        given.filter(F.col("ride_id").isin(*ids)).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        rides.keep_ride_sums(rides.clean_rides(stream), folder, checkpoint).awaitTermination()

    def same(expected):
        kept = rides.report_of_sums(stored_sums(spark, folder, rides.SUM_KEYS))
        whole = rides.ride_usage_report(rides.clean_rides(expected))
        assert {name: rows(table) for name, table in kept.items()} == {name: rows(table) for name, table in whole.items()}

    arrive("r1", "r3")
    same(given.filter(F.col("ride_id").isin("r1", "r3")))
    arrive("r2", "r4", "r6")
    arrive("r5", "r7")
    same(given)
    # the last batch once more under its number, as after a failure between the write and the commit
    last = rides.clean_rides(given.filter(F.col("ride_id").isin("r5", "r7")))
    store_arrival(rides.ride_sums(last), folder, 2)
    same(given)
    store_arrival(rides.ride_sums(last.limit(0)), folder, 3)
    same(given)


# --- cars ------------------------------------------------------------------------------------

def car(year, month, rec, kind, sales, price=10.0, gdp=1.0, ads=100.0, unemployment=5.0):
    return (year, month, rec, kind, sales, price, gdp, 0.5, unemployment, ads)


CARS = [car(1980, "Jan", 1, "Sports", 10.0, ads=300.0), car(1980, "Feb", 1, "Family", 30.0, price=20.0),
        car(1980, "Feb", 1, "Family", None, price=40.0), car(1981, "Jan", 0, "Truck", 50.0, gdp=3.0, ads=500.0)]


@pytest.mark.parametrize("staged", [True, False])
def test_car_reports(spark, staged):
    df = spark.createDataFrame(CARS, schemas.CAR_SALES)
    rec = cars.run_report(cars.RECESSION, df, staged=staged)
    assert rows(rec["sales_by_year"]) == [(1980, 20.0)]
    assert rows(rec["sales_by_type"]) == [("Family", 30.0), ("Sports", 10.0)]
    assert rows(rec["ads_by_type"]) == [("Family", 200.0, 40.0), ("Sports", 300.0, 60.0)]
    assert rows(rec["sales_by_unemployment"]) == [(5.0, "Family", 30.0), (5.0, "Sports", 10.0)]
    yearly = cars.run_report(cars.YEARLY, df, 1981, staged=staged)
    assert rows(yearly["sales_by_year"]) == [(1980, 20.0), (1981, 50.0)]
    assert rows(yearly["sales_by_month"]) == [("Feb", 30.0), ("Jan", 60.0)]
    assert rows(yearly["sales_by_type"]) == [("Truck", 50.0)] and rows(yearly["ads_by_type"]) == [("Truck", 500.0, 100.0)]
    assert cars.run_report(cars.YEARLY, df) == {} and cars.run_report("other", df, 1981) == {}
    both = cars.recession_comparison(df, staged)
    assert rows(both["ads_by_period"]) == [("Non-Recession", 500.0, 50.0), ("Recession", 500.0, 50.0)]
    assert rows(both["price_and_sales_by_type"]) == [("Family", 30.0, 30.0), ("Sports", 10.0, 10.0)]
    assert rows(both["gdp_otherwise"]) == [(1981, 3.0)] and rows(both["gdp_in_recession"]) == [(1980, 1.0)]
    assert rows(cars.bubble_points(df).select("size")) == [(100.0,), (20.0,), (20.0,), (60.0,)]


def test_sales_trend_has_a_point_band_for_single_rows(spark):
    df = spark.createDataFrame(CARS, schemas.CAR_SALES)
    got = {r[1]: tuple(r)[3:] for r in cars.sales_trend(df, 50).collect()}
    assert got == {"Sports": (10.0, 10.0, 10.0), "Family": (30.0, 30.0, 30.0), "Truck": (50.0, 50.0, 50.0)}


# --- fitness ---------------------------------------------------------------------------------

def test_activity_cleaning(spark, tmp_path):
    daily = spark.createDataFrame(
        [(1, "4/12/2016", 100, 10, 20, 30, 3, 9), (2, "bad", 50, 1, 1, 1, 0, 9), (None, "4/17/2016", 70, 0, 0, 600, 0, 9)],
        schemas.DAILY_ACTIVITY)
    sleep = spark.createDataFrame(
        [(1, "4/12/2016 12:00:00 AM", 327, 346)] * 2 + [(2, None, None, 60)] * 3, schemas.SLEEP_DAY)
    weight = spark.createDataFrame([(1,), (1,), (5,)], "Id long")
    hour = "4/12/2016 1:00:00 PM"
    hourly = [spark.createDataFrame([(1, hour, 5), (None, hour, 6), (9, hour, 7)], schemas.HOURLY_INTENSITIES),
              spark.createDataFrame([(1, hour, 50), (None, hour, 60)], schemas.HOURLY_CALORIES),
              spark.createDataFrame([(1, hour, 500), (None, hour, 600), (1, "4/12/2016 2:00:00 PM", 1)], schemas.HOURLY_STEPS)]
    out = fitness.activity_cleaning(daily, sleep, weight, hourly)
    got = rows(out["daily_activity"].select("id", "activitydate", "day_of_week", "day_of_week_order", "total_active_hours"))
    assert got == [(None, day("2016-04-17"), "Sunday", 7, 10.0), (1, day("2016-04-12"), "Tuesday", 2, 1.05), (2, None, None, None, 0.05)]
    assert rows(out["daily_sleep"].select("id", "sleepday", "total_hour_in_bed", "total_hour_asleep")) == [
        (1, ts("2016-04-12"), 5.77, 5.45), (2, None, 1.0, None)]
    assert rows(out["hourly_activity"]) == [(None, ts("2016-04-12 13:00:00"), 6, 60, 600), (1, ts("2016-04-12 13:00:00"), 5, 50, 500)]
    checks = {k: rows(v)[0][0] for k, v in out.items() if k.startswith(("participants", "duplicates"))}
    assert checks == {"participants_daily": 3, "participants_sleep": 2, "participants_weight": 2, "participants_hourly": 2,
                      "duplicates_daily": 0, "duplicates_sleep": 3, "duplicates_hourly": 0, "duplicates_sleep_after": 0}
    fitness.export_cleaned(out, str(tmp_path))
    back = read_table(spark, f"{tmp_path}/daily_sleep")
    assert back.columns[0] == "_row" and [r[0] for r in back.orderBy("_row").collect()] == [1, 2]


def test_weekday_and_hour_profiles(spark):
    df = spark.createDataFrame([("Sunday", 10.0, 1.0), ("Monday", 4.0, 3.0), ("Monday", 6.0, None)], "day_of_week string, a double, b double")
    got = rows(fitness.minutes_by_weekday_and_type(df, ["a", "b"]), True)
    assert [r[:3] for r in got] == [("Monday", "a", 5.0), ("Monday", "b", 3.0), ("Sunday", "a", 10.0), ("Sunday", "b", 1.0)]
    assert [r[0] for r in rows(fitness.steps_by_weekday(df, "a"), True)] == ["Monday", "Sunday"]
    hours = spark.createDataFrame([(ts("2016-04-12 17:00:00"), 5.0), (ts("2016-04-13 17:59:00"), 7.0), (ts("2016-04-12 12:00:00"), 1.0)], "t timestamp, s double")
    assert rows(fitness.top_hours(hours, "t", "s", 1)) == [(17, 6.0, 1)]


# --- launches --------------------------------------------------------------------------------

def core(c, success, kind, flight=1):
    return {"core": c, "flight": flight, "gridfins": True, "legs": False, "reused": False,
            "landing_success": success, "landing_type": kind, "landpad": None}


def record(n, rocket, payloads, pad, cores, date):
    return {"rocket": rocket, "payloads": payloads, "launchpad": pad, "cores": cores, "flight_number": n, "date_utc": date, "extra": 1}


RECORDS = [
    record(1, "f1", ["p1"], "kw", [core("c1", None, None)], "2006-03-24T22:30:00.000Z"),          # Falcon 1
    record(2, "f9", ["p1"], "ks", [core("c1", True, "ASDS")], "2010-06-04T18:45:00.000Z"),
    record(3, "f9", ["p1", "p2"], "ks", [core("c1", True, "ASDS")], "2011-01-01T00:00:00.000Z"),   # two payloads
    record(4, "fh", ["p1"], "ks", [core("c1", True, "RTLS"), core("c2", True, "RTLS")], "2012-01-01T00:00:00.000Z"),
    record(5, "f9", ["p2"], "ks", [core(None, None, None)], "2020-11-13T23:59:59.000Z"),           # mass missing, last day
    record(6, "f9", ["p1"], "ks", [core("c1", True, "ASDS")], "2020-11-14T00:00:00.000Z"),         # a day late
    record(7, "??", ["p3"], "??", [core("c2", False, "Ocean")], "2015-01-01T00:00:00.000Z"),       # unknown rocket
    record(8, "f9", [], "ks", [], "2015-01-01T00:00:00.000Z"),
    record(9, "f9", None, "ks", None, "2015-01-01T00:00:00.000Z"),
]


def test_collect_launches(spark, tmp_path):
    path = tmp_path / "launches.json"
    path.write_text(json.dumps(RECORDS))
    df = launches.collect_launches(
        read_json_records(spark, str(path), schemas.LAUNCHES),
        spark.createDataFrame([("f1", "Falcon 1"), ("f9", "Falcon 9")], schemas.ROCKETS),
        spark.createDataFrame([("kw", "Kwajalein", 1.0, 2.0), ("ks", "KSC", 3.0, 4.0)], schemas.LAUNCHPADS),
        spark.createDataFrame([("p1", 100.0, "LEO"), ("p2", None, "GTO"), ("p3", 300.0, "ISS")], schemas.PAYLOADS),
        spark.createDataFrame([("c1", 1, 2, "B1"), ("c2", 5, 0, "B2")], schemas.CORES))
    assert len(df.columns) == 17
    got = [tuple(r) for r in df.orderBy("FlightNumber").select(
        "FlightNumber", "Date", "BoosterVersion", "PayloadMass", "Outcome", "LaunchSite", "Serial").collect()]
    assert got == [
        (1, day("2010-06-04"), "Falcon 9", 100.0, "True ASDS", "KSC", "B1"),
        (2, day("2020-11-13"), "Falcon 9", 200.0, "None None", "KSC", None),
        (3, day("2015-01-01"), None, 300.0, "False Ocean", None, "B2"),
    ]


def test_launch_labels(spark):
    counts = {"True ASDS": 9, "None None": 8, "True RTLS": 7, "False ASDS": 6, "True Ocean": 5, "False Ocean": 4, "None ASDS": 3, "False RTLS": 2}
    data = [(o, "s", "LEO") for o, n in counts.items() for _ in range(n)] + [(None, None, "GTO")]
    df = spark.createDataFrame(data, "Outcome string, LaunchSite string, Orbit string")
    out = launches.launch_labelling(df)
    bad = {r["Outcome"] for r in out["labelled"].filter("Class = 0").collect()}
    assert bad == {"None None", "False ASDS", "False Ocean", "None ASDS", "False RTLS"}
    assert abs(rows(out["success_rate"])[0][0] - 22 / 45) < 1e-12  # a missing outcome counts as good
    assert rows(out["outcomes"], True)[0] == ("True ASDS", 9) and rows(out["sites"]) == [("s", 44)]
    by_name = launches.label_launches(df, bad_outcomes=["None None"])
    assert by_name.filter("Class = 0").count() == 8


LAUNCHED = [
    (day("2010-06-04"), "CCAFS LC-40", 4000.0, "NASA (CRS)", "F9 v1.1", "Failure (drone ship)", "Success"),
    (day("2015-01-10"), "ccafs slc", 5000.0, "NASA (CRS)", "F9 v1.1", "Failure (drone ship) x", "Success"),
    (day("2015-12-31"), "KSC", 9000.0, "SES", "F9 FT", "Success (ground pad)", "Failure"),
    (day("2017-03-20"), "KSC", 9000.0, "SES", "F9 B4", "Success (drone ship)", None),
    (day("2017-03-21"), "KSC", 5500.0, "SES", "F9 B5", "Success (drone ship)", None),
    (None, "CCAFS", 1.0, "NASA (CRS)", "F9 v1.1", "Success (drone ship)", "Success"),
]

def test_launch_questions_as_frames_and_as_sql(spark, tmp_path):
    df = spark.createDataFrame(LAUNCHED, schemas.LAUNCH_TABLE)
    table = launches.prepare_launch_table(df, "launch_table", f"{tmp_path}/t")
    assert table.count() == 5
    answers = launches.launch_questions(df)
    want = {
        "sites": [("CCAFS LC-40",), ("KSC",), ("ccafs slc",)],
        "mass_for_customer": [(9000.0,)], "mean_mass_of_booster": [(4500.0,)],
        "first_ground_success": [(day("2015-12-31"),)], "boosters_in_mass_range": [("F9 B5",)],
        "mission_outcomes": [(None, 2), ("Failure", 1), ("Success", 2)],
        "boosters_at_max_mass": [("F9 B4",), ("F9 FT",)],
        "ship_failures_of_year": [("01", "Failure (drone ship) x", "F9 v1.1", "ccafs slc")],
        "ranked_outcomes": [("Failure (drone ship)", 1), ("Failure (drone ship) x", 1), ("Success (drone ship)", 1), ("Success (ground pad)", 1)],
    }
    for question, answer in answers.items():
        asked = launches.launch_sql(spark, question, "launch_table")
        assert rows(answer) == rows(asked), question
        if question in want:
            assert rows(answer) == want[question], question
    assert answers["first_at_site"].count() == 2
    for prefix in ("CC_", "%", "ccafs l"):  # text, not a pattern
        by_frame = launches.launch_questions(df, site_prefix=prefix)["first_at_site"]
        assert rows(launches.launch_sql(spark, "first_at_site", "launch_table", site_prefix=prefix)) == rows(by_frame)
    assert "make_date" not in launches.launch_sql(spark, "ship_failures_of_year", "launch_table")._jdf.queryExecution().executedPlan().toString()


def test_silent_buckets_count_as_zero(spark):
    steady = [(at(60 * h + 5), "steady", "x") for h in range(40)]
    burst = [(at(60 * 20), "quiet", "x")] * 30  # one loud hour, silent otherwise
    got = rows(network.traffic_spikes(events(spark, steady + burst), "ts", "account", "1 hour", 3.0))
    assert [(r[0], r[1], r[2], round(r[3], 4)) for r in got] == [("quiet", at(60 * 20), 30, 0.75)]


# --- network ---------------------------------------------------------------------------------

def events(spark, data, schema="ts timestamp, account string, source string"):
    return spark.createDataFrame(data, schema)


def at(minutes):
    return ts("2024-01-01 00:00:00") + datetime.timedelta(minutes=minutes)


def test_spikes_need_deviation(spark):
    steady = [(at(60 * h + 5), "steady", "x") for h in range(12)]
    burst = [(at(60 * h + 5), "burst", "x") for h in range(12)] + [(at(125), "burst", "y")] * 40
    got = rows(network.traffic_spikes(events(spark, steady + burst), "ts", "account", "1 hour", 3.0))
    assert [(r[0], r[1], r[2]) for r in got] == [("burst", at(120), 41)]


def test_credential_stuffing(spark):
    many = [(at(8 + i), "victim", f"s{i}") for i in range(5)]      # 5 sources across a bucket border
    one = [(at(i), "typist", "home") for i in range(9)]            # many attempts, one source
    got = network.credential_stuffing(events(spark, many + one), "ts", "account", "source", "10 minutes", "5 minutes", 4, 3)
    assert rows(got) == [(at(5), at(15), "victim", 5, 5)]
    with pytest.raises(ValueError, match="multiple"):
        network.credential_stuffing(events(spark, many), "ts", "account", "source", "10 minutes", "3 minutes", 4, 3)


def test_sliding_windows_in_full_without_repeated_attempts(spark):
    dealt = random.Random(3)
    log = [(at(dealt.choice([0, 400]) + dealt.randrange(90)), dealt.choice(["a", "b", None]), dealt.choice(["s", "t", "u", None]))
           for _ in range(160)]
    log += [(at(1000), "c", "s"), (at(1010), "c", "t"), (at(1030), "c", "s"), (at(1030), "c", "s")]  # the second s begins as the first one's windows end
    held = {}
    for when, account, source in log:
        step = when.replace(minute=when.minute // 5 * 5, second=0)
        for k in range(6):
            held.setdefault((step - datetime.timedelta(minutes=5 * k), account), []).append(source)
    for attempts, sources in ((4, 3), (2, 2), (0, 0)):
        got = network.credential_stuffing(events(spark, log), "ts", "account", "source", "30 minutes", "5 minutes", attempts, sources)
        want = [(start, start + datetime.timedelta(minutes=30), account, len(found), len(set(found) - {None}))
                for (start, account), found in held.items()
                if len(found) >= attempts and len(set(found) - {None}) >= sources]
        assert sorted(rows(got), key=str) == sorted(want, key=str) and len(want) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan  # six rows an attempt here, as many as the width has steps


def test_unusual_access_and_trend(spark):
    df = spark.createDataFrame([("u", f"r{i}") for i in range(12)] + [("u", "secret")] * 30 + [("v", "r1")], "user string, resource string")
    assert [r[:3] for r in rows(network.unusual_access(df, "user", "resource", 3.0))] == [("u", "secret", 30)]
    days = spark.createDataFrame([(ts(f"2024-0{m}-01 00:00:00"),) for m in (1, 2, 2, 3, 3, 3)], "t timestamp")
    slope, intercept, period, forecast = rows(network.monthly_trend(days, "t"))[0]
    assert round(slope, 6) == 1.0 and period == 2024 * 12 + 3 and round(forecast, 4) == 4.0


def test_access_right_on_the_bound(spark):
    counts = [3, 12, 10, 10, 7, 3, 11, 4, 9]  # the 12 lies 13/10 deviations of 10/3 above the mean of 23/3
    dealt = random.Random(1)
    log = [(u, f"r{j}") for u in range(300) for j, n in enumerate(dealt.sample(counts, 9)) for _ in range(n)]
    df = spark.createDataFrame(log, "user int, resource string")
    assert network.unusual_access(df, "user", "resource", 1.3).count() == 0
    above = network.unusual_access(df, "user", "resource", 1.29).select("mean", "deviation", "z")
    assert rows(above) == [(69 / 9, 30 / 9, 1.3)] * 300


def test_volumes(spark):
    df = spark.createDataFrame([(1, "DDoS", True), (1, "Malware", None), (2, "DDoS", False), (3, "DDoS", True)], "m int, attack string, ioc boolean")
    assert rows(network.counts_per_period(df, F.col("m"), "month", F.col("attack") == "DDoS")) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert rows(network.busiest_periods(df, F.col("m"), 1, "month")) == [(1, 2, 1)]
    assert rows(network.detection_by_period(df, F.col("m"), F.col("ioc"), "month")) == [(1, 1, 1), (2, 0, 1), (3, 1, 0)]
    assert rows(network.shares_by(df, "attack"), True) == [("DDoS", 75.0), ("Malware", 25.0)]
    assert rows(network.attempts_by_transport(df, "attack"), True) == [("DDoS", 3), ("Malware", 1)]
    assert rows(network.packet_length_histogram(df, "attack", "m", 2.0)) == [("DDoS", 0, 0.0, 1), ("DDoS", 1, 2.0, 2), ("Malware", 0, 0.0, 1)]
    assert rows(network.packet_length_summary(df, "attack", "m").select("attack", "median")) == [("DDoS", 2.0), ("Malware", 1.0)]
