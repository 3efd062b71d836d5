"""The composed reports and jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.catalog.inputs import CARS, CLEAN_RIDES, LAUNCHES, cars, launches, rides
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators.columns import clean_column_names
from tallywork.operators.sets import union_all
from tallywork.plans import cars as car_plans
from tallywork.plans import fitness, launches as launch_plans
from tallywork.plans import rides as ride_plans
from tallywork.session import scratch_path
from tallywork.sources.tables import read_json_records, read_table
from tallywork.streaming.kept_sums import stored_sums

# --- car sales -------------------------------------------------------------------------------

_ADS = """sums AS (SELECT "Vehicle_Type", sum("Advertising_Expenditure") AS ads FROM cars WHERE {where} GROUP BY ALL)
    SELECT "Vehicle_Type", round(ads, 2) AS "Advertising_Expenditure",
           round_even(ads * 100 / (SELECT sum(ads) FROM sums), 1) AS percent FROM sums"""


def _mean(value: str, keys: str, where: str = "true") -> str:
    return f"""WITH {CARS} SELECT {keys}, round(avg("{value}"), 2) AS "{value}" FROM cars WHERE {where} GROUP BY ALL"""


_RECESSION_SQL = {
    "sales_by_year": _mean("Automobile_Sales", '"Year"', '"Recession" = 1'),
    "sales_by_type": _mean("Automobile_Sales", '"Vehicle_Type"', '"Recession" = 1'),
    "ads_by_type": f"WITH {CARS}, " + _ADS.format(where='"Recession" = 1'),
    "sales_by_unemployment": _mean("Automobile_Sales", 'unemployment_rate, "Vehicle_Type"', '"Recession" = 1'),
}
_YEARLY_SQL = {
    "sales_by_year": _mean("Automobile_Sales", '"Year"'),
    "sales_by_month": f"""WITH {CARS} SELECT "Month", round(sum("Automobile_Sales"), 2) AS "Automobile_Sales" FROM cars GROUP BY ALL""",
    "sales_by_type": _mean("Automobile_Sales", '"Vehicle_Type"', '"Year" = 1999'),
    "ads_by_type": f"WITH {CARS}, " + _ADS.format(where='"Year" = 1999'),
}
_COMPARISON_SQL = {
    "gdp_in_recession": _mean("GDP", '"Year"', '"Recession" = 1'),
    "gdp_otherwise": _mean("GDP", '"Year"', '"Recession" = 0'),
    "sales_by_year_and_type": _mean("Automobile_Sales", '"Year", "Vehicle_Type"', '"Recession" = 1'),
    "price_and_sales_by_type": f"""WITH {CARS} SELECT "Vehicle_Type", round(avg("Price"), 2) AS "Price",
        round(avg("Automobile_Sales"), 2) AS "Automobile_Sales" FROM cars WHERE "Recession" = 1 GROUP BY ALL""",
    "ads_by_period": f"""WITH {CARS}, sums AS (
            SELECT CASE "Recession" WHEN 1 THEN 'Recession' ELSE 'Non-Recession' END AS period,
                   sum("Advertising_Expenditure") AS ads FROM cars GROUP BY ALL)
        SELECT period, round(ads, 2) AS "Advertising_Expenditure",
               round_even(ads * 100 / (SELECT sum(ads) FROM sums), 1) AS percent FROM sums""",
    "ads_by_type": _RECESSION_SQL["ads_by_type"],
}


def _report(prefix: str, covers: str, sqls: dict[str, str], build) -> None:
    """Register one query per table of a report."""
    for name, sql in sqls.items():
        query(f"{prefix}_{name}", covers, sql)(lambda t, name=name: longs(rounded(build(t)[name], 2)))


_report("recession", "R1 R3", _RECESSION_SQL, lambda t: car_plans.run_report(car_plans.RECESSION, cars(t), staged=False))
_report("yearly", "R2 R3", _YEARLY_SQL, lambda t: car_plans.run_report(car_plans.YEARLY, cars(t), 1999, staged=False))
_report("comparison", "R4", _COMPARISON_SQL, lambda t: car_plans.recession_comparison(cars(t), staged=False))


@query("bubble_points", "P3", f"""
    WITH {CARS} SELECT "Seasonality_Weight", "Automobile_Sales", "Year", round("Advertising_Expenditure" / 5, 4) AS size
    FROM cars""")
def _(t: Tables):
    return rounded(car_plans.bubble_points(cars(t)), 4, "size")


# --- rides -----------------------------------------------------------------------------------

_MONTHS = "member_casual, month, month_name"
_RIDE_SQL = {
    "rider_share": f"""WITH {CLEAN_RIDES} SELECT member_casual,
        round_even(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent FROM clean GROUP BY ALL""",
    "length_by_rider": f"""WITH {CLEAN_RIDES} SELECT member_casual, round(avg(ride_length), 2) AS ride_length
        FROM clean GROUP BY ALL""",
    "length_share_by_rider": f"""WITH {CLEAN_RIDES} SELECT member_casual, round(avg(ride_length), 2) AS ride_length,
        round_even(avg(ride_length) * 100 / sum(avg(ride_length)) OVER (), 1) AS percent FROM clean GROUP BY ALL""",
    "length_by_month": f"""WITH {CLEAN_RIDES} SELECT {_MONTHS}, round(avg(ride_length), 2) AS ride_length
        FROM clean GROUP BY ALL""",
    "rides_by_bike": f"""WITH {CLEAN_RIDES} SELECT member_casual, rideable_type, count(ride_id) AS count
        FROM clean GROUP BY ALL""",
    "rides_by_month": f"""WITH {CLEAN_RIDES} SELECT {_MONTHS}, count(ride_id) AS ride_id FROM clean GROUP BY ALL""",
}
_report("rides", "R5", _RIDE_SQL, lambda t: ride_plans.ride_usage_report(ride_plans.clean_rides(rides(t)), staged=False))


_WHOLE_RIDES = f"""
    WITH {CLEAN_RIDES} SELECT 'rider' AS part, member_casual AS k, round(avg(ride_length), 2) AS v FROM clean GROUP BY ALL
    UNION ALL SELECT 'month', member_casual || month_name, round(avg(ride_length), 2) FROM clean GROUP BY ALL
    UNION ALL SELECT 'bike', member_casual || rideable_type, count(*)::DOUBLE FROM clean GROUP BY ALL
    UNION ALL SELECT 'weekday', member_casual || weekday, round(avg(ride_length), 2) FROM clean GROUP BY ALL"""


def _whole_rides(report):
    rider = F.col("member_casual")
    parts = [("rider", "length_by_rider", rider, "ride_length"),
             ("month", "length_by_month", F.concat(rider, "month_name"), "ride_length"),
             ("bike", "rides_by_bike", F.concat(rider, "rideable_type"), "count"),
             ("weekday", "length_by_weekday", F.concat(rider, "weekday"), "ride_length")]
    return union_all([
        report[table].select(F.lit(part).alias("part"), k.alias("k"), F.round(F.col(v).cast("double"), 2).alias("v"))
        for part, table, k, v in parts])


@query("rides_whole_report", "R5", _WHOLE_RIDES)
def _(t: Tables):
    # several tables of one staged report: the rides are read once
    return _whole_rides(ride_plans.ride_usage_report(ride_plans.clean_rides(rides(t))))


@query("rides_report_kept_up", "R5 S2", _WHOLE_RIDES)
def _(t: Tables):
    # rides arrive as files; each batch of them adds its sums, and the report reads the sums alone
    arrivals, kept, checkpoint = (scratch_path(t.spark, f"rides-{label}") for label in ("in", "sums", "checkpoint"))
    given = rides(t)
    given.write.parquet(arrivals)
    stream = t.spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 16).parquet(arrivals)
    ride_plans.keep_ride_sums(ride_plans.clean_rides(stream), kept, checkpoint).awaitTermination()
    return _whole_rides(ride_plans.report_of_sums(stored_sums(t.spark, kept, ride_plans.SUM_KEYS)))


@query("rides_labelled_months", "R5 P16", f"""
    WITH {CLEAN_RIDES}, labels AS (
        SELECT unnest(range(1, 13)) AS month, unnest([{", ".join(f"'{v}'" for v in ride_plans.MONTH_LABELS.values())}]) AS label)
    SELECT {_MONTHS}, round(avg(ride_length), 2) AS ride_length, label AS month_label, NULL::VARCHAR AS member_casual_label
    FROM clean JOIN labels USING (month) GROUP BY ALL""")
def _(t: Tables):
    report = ride_plans.ride_usage_report(ride_plans.clean_rides(rides(t)), staged=False)
    labelled = ride_plans.labelled({"m": report["length_by_month"]})["m"]
    return longs(rounded(labelled, 2))


@query("rides_cross_table", "R5 A21", f"""
    WITH {CLEAN_RIDES} SELECT member_casual,
        {", ".join(f'round(avg(CASE WHEN month = {m} THEN ride_length END), 2) AS "m{m}"' for m in range(1, 13))}
    FROM clean GROUP BY ALL""")
def _(t: Tables):
    report = ride_plans.ride_usage_report(ride_plans.clean_rides(rides(t)), staged=False)
    table = ride_plans.length_by_rider_and_month(report["length_by_month"])
    return rounded(table.toDF("member_casual", *[f"m{m}" for m in range(1, 13)]), 2)


# --- activity trackers -----------------------------------------------------------------------

# per account and day: events of each type as minutes, their values as steps and calories
DAILY = """daily AS (
    SELECT user_id AS id, ts::DATE AS day, count_if(event_type = 'click') AS fairlyactiveminutes,
           count_if(event_type = 'view') AS lightlyactiveminutes, count_if(event_type = 'error') AS sedentaryminutes,
           count_if(event_type = 'purchase') AS veryactiveminutes, sum(floor(value))::BIGINT AS totalsteps
    FROM events GROUP BY ALL)"""


def daily_activity(t: Tables):
    def minutes(kind: str, name: str):
        return F.count_if(F.col("event_type") == kind).cast("int").alias(name)

    grouped = t.events.groupBy(F.col("user_id").alias("Id"), F.to_date("ts").alias("day")).agg(
        minutes("click", "FairlyActiveMinutes"), minutes("view", "LightlyActiveMinutes"),
        minutes("error", "SedentaryMinutes"), minutes("purchase", "VeryActiveMinutes"),
        F.sum(F.floor("value")).alias("TotalSteps"))
    return grouped.select("Id", F.date_format("day", "M/d/yyyy").alias("ActivityDate"), *grouped.columns[2:])


def sleep_days(t: Tables):
    """Signups as nights; a night of more than 100 minutes was recorded twice."""
    nights = t.events.filter("event_type = 'signup'").select(
        F.col("user_id").alias("Id"), F.date_format(F.to_date("ts"), "M/d/yyyy h:mm:ss a").alias("SleepDay"),
        F.floor("value").cast("int").alias("TotalMinutesAsleep"),
        F.ceil(F.col("value") * 1.5).cast("int").alias("TotalTimeInBed"))
    return nights.union(nights.filter("TotalMinutesAsleep > 100"))


def hourly_texts(t: Tables):
    from tallywork.catalog.inputs import hourly

    return [df.select("Id", F.date_format("hour", "M/d/yyyy h:mm:ss a").alias("ActivityHour"), df.columns[2])
            for df in hourly(t)]


@query("activity_daily", "R6 P4 H2 H6 P16 O2", f"""
    WITH {DAILY} SELECT id, day AS activitydate, dayname(day) AS day_of_week, (dayofweek(day) + 6) % 7 + 1 AS day_of_week_order,
        totalsteps, round_even(((fairlyactiveminutes + lightlyactiveminutes + sedentaryminutes + veryactiveminutes) / 60)::DECIMAL(18, 6), 2)::DOUBLE
            AS total_active_hours
    FROM daily""")
def _(t: Tables):
    df = fitness.clean_daily_activity(daily_activity(t))
    return longs(df.select("id", "activitydate", "day_of_week", "day_of_week_order", "totalsteps", "total_active_hours"))


_NIGHTS = """nights AS (
    SELECT user_id AS id, ts::DATE AS day, floor(value)::BIGINT AS asleep, ceil(value * 1.5)::BIGINT AS in_bed
    FROM events WHERE event_type = 'signup'),
    recorded AS (SELECT * FROM nights UNION ALL SELECT * FROM nights WHERE asleep > 100)"""


@query("activity_sleep", "R6 U2 H2 H7", f"""
    WITH {_NIGHTS} SELECT DISTINCT id, day::TIMESTAMP AS sleepday,
        round_even((in_bed / 60)::DECIMAL(18, 6), 2)::DOUBLE AS total_hour_in_bed,
        round_even((asleep / 60)::DECIMAL(18, 6), 2)::DOUBLE AS total_hour_asleep, in_bed, asleep
    FROM recorded""")
def _(t: Tables):
    df = fitness.clean_sleep(sleep_days(t))
    return longs(df.select("id", F.col("sleepday").cast("timestamp_ntz").alias("sleepday"), "total_hour_in_bed",
                           "total_hour_asleep", F.col("totaltimeinbed").alias("in_bed"),
                           F.col("totalminutesasleep").alias("asleep")))


@query("activity_sleep_duplicates", "R6 A16", f"""
    WITH {_NIGHTS} SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM recorded GROUP BY id, day, asleep, in_bed)""")
def _(t: Tables):
    checks = fitness.activity_cleaning(daily_activity(t), sleep_days(t), sleep_days(t), hourly_texts(t))
    return checks["duplicates_sleep"]


_CHECKS = {
    "participants_daily": "SELECT count(DISTINCT user_id) AS n FROM events",
    "participants_hourly": """SELECT count(DISTINCT user_id) AS n FROM (
        SELECT user_id, date_trunc('hour', ts) AS hour FROM events GROUP BY ALL
        HAVING bool_or(event_type <> 'error') AND bool_or(event_type <> 'signup') AND bool_or(event_type <> 'view'))""",
    "participants_sleep": f"WITH {_NIGHTS} SELECT count(DISTINCT id) AS n FROM recorded",
    "participants_weight": f"WITH {_NIGHTS} SELECT count(DISTINCT id) AS n FROM recorded",
    "duplicates_daily": "SELECT 0::BIGINT AS n FROM (SELECT count(*) FROM events)",
    "duplicates_hourly": "SELECT 0::BIGINT AS n FROM (SELECT count(*) FROM events)",
    "duplicates_sleep_after": f"WITH {_NIGHTS} SELECT 0::BIGINT AS n FROM (SELECT count(*) FROM recorded)",
}


def _check(t: Tables, name: str):
    tables = fitness.activity_cleaning(daily_activity(t), sleep_days(t), sleep_days(t), hourly_texts(t))
    return longs(tables[name].toDF("n"))


for _name, _sql in _CHECKS.items():
    query(f"activity_check_{_name}", "R6 A15 A16", _sql)(lambda t, name=_name: _check(t, name))


@query("activity_export", "R6 S7 P17", f"""
    WITH {_NIGHTS}, kept AS (SELECT DISTINCT id, day, in_bed, asleep FROM recorded)
    SELECT row_number() OVER (ORDER BY id, day, asleep, in_bed) AS _row, id, asleep, in_bed FROM kept""")
def _(t: Tables):
    """The numbered sleep table, read back from the exported CSV."""
    tables = fitness.activity_cleaning(daily_activity(t), sleep_days(t), sleep_days(t), hourly_texts(t))
    folder = scratch_path(t.spark, "export")
    fitness.export_cleaned(tables, folder)
    back = read_table(t.spark, f"{folder}/daily_sleep", "_row long, id long, totalminutesasleep long, totaltimeinbed long")
    return back.toDF("_row", "id", "asleep", "in_bed")


@query("activity_hourly", "R6 J2 H2", """
    WITH hours AS (SELECT user_id AS id, date_trunc('hour', ts) AS hour, event_type, value FROM events)
    SELECT id, hour AS activityhour, count_if(event_type <> 'error')::BIGINT AS steps,
           round(sum(CASE WHEN event_type <> 'signup' THEN value END), 2) AS calories,
           max(CASE WHEN event_type <> 'view' THEN value END) AS intensity
    FROM hours GROUP BY ALL
    HAVING bool_or(event_type <> 'error') AND bool_or(event_type <> 'signup') AND bool_or(event_type <> 'view')""")
def _(t: Tables):
    df = fitness.merge_hourly(hourly_texts(t))
    return rounded(df.withColumn("activityhour", F.col("activityhour").cast("timestamp_ntz")), 2, "calories")


# --- launches --------------------------------------------------------------------------------

_LAST_DAY = datetime.date(1999, 6, 30)


def launch_records(t: Tables):
    """One launch per order: its lines are the cores, their parts the payloads; read from JSON."""
    line = F.struct(
        F.col("l_suppkey").cast("string").alias("core"), F.col("l_linenumber").alias("flight"),
        (F.col("l_discount") > 0.05).alias("gridfins"), (F.col("l_tax") > 0.04).alias("legs"),
        (F.col("l_returnflag") == "A").alias("reused"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "O").alias("landing_success"),
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("landing_type"), F.col("l_returnflag").alias("landpad"))
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(line).alias("cores"), F.collect_list(F.col("l_partkey").cast("string")).alias("payloads"),
        F.min("l_suppkey").cast("string").alias("launchpad"))
    orders = t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("rocket"), F.col("o_orderkey").alias("flight_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date_utc"))
    records = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey", "l_orderkey")
    path = scratch_path(t.spark, "launches")
    records.write.json(path)
    return read_json_records(t.spark, path, schemas.LAUNCHES, multi_line=False)


def launch_dimensions(t: Tables):
    rockets = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name"))
    pads = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
                             F.col("s_acctbal").alias("longitude"), F.col("s_nationkey").cast("double").alias("latitude"))
    payloads = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("orbit"),
                             F.when(F.col("p_size") <= 40, F.col("p_retailprice")).alias("mass_kg"))
    cores = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").alias("block"),
                              F.length("s_name").alias("reuse_count"), F.col("s_name").alias("serial"))
    return rockets, pads, payloads, cores


@query("collect_launches", "R7 S3 P1 P13 H11 H12 H3 P7 J3 H10 P10 P17 M1", """
    WITH single AS (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) = 1),
    flights AS (
        SELECT o_orderkey, o_orderdate::DATE AS "Date", c_mktsegment AS "BoosterVersion",
               CASE WHEN p_size <= 40 THEN p_retailprice END AS mass, p_type AS "Orbit", s_name AS "LaunchSite",
               CASE WHEN l_returnflag = 'N' THEN 'None' WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END
                   || ' ' || CASE WHEN l_returnflag = 'R' THEN 'None' ELSE l_returnflag END AS "Outcome",
               l_linenumber::BIGINT AS "Flights", l_discount > 0.05 AS "GridFins", l_returnflag = 'A' AS "Reused",
               l_tax > 0.04 AS "Legs", l_returnflag AS "LandingPad", s_nationkey::BIGINT AS "Block",
               length(s_name) AS "ReusedCount", s_name AS "Serial", s_acctbal AS "Longitude",
               s_nationkey::DOUBLE AS "Latitude"
        FROM single JOIN lineitem USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE o_orderdate::DATE <= DATE '1999-06-30' AND c_mktsegment <> 'BUILDING')
    SELECT * EXCLUDE (o_orderkey, mass), row_number() OVER (ORDER BY o_orderkey) AS "FlightNumber",
           round(coalesce(mass, (SELECT avg(mass) FROM flights)), 4) AS "PayloadMass" FROM flights""")
def _(t: Tables):
    df = launch_plans.collect_launches(launch_records(t), *launch_dimensions(t), _LAST_DAY, "BUILDING")
    return longs(rounded(df, 4, "PayloadMass"))


def outcomes(t: Tables):
    return launches(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("Launch_Site").alias("LaunchSite"), F.col("Customer").alias("Orbit"),
        F.concat_ws(" ", "Landing_Outcome", "Booster_Version").alias("Outcome"))


_OUTCOMES = LAUNCHES + """, outcomes AS (
    SELECT l_orderkey, l_linenumber, l_partkey, "Launch_Site" AS "LaunchSite", "Customer" AS "Orbit",
           "Landing_Outcome" || ' ' || "Booster_Version" AS "Outcome" FROM launches),
    bad AS (SELECT "Outcome" FROM outcomes GROUP BY "Outcome"
            QUALIFY row_number() OVER (ORDER BY count(*) DESC, "Outcome") - 1 IN (1, 3, 5, 6, 7))"""
_LABELLED = """SELECT *, CASE WHEN "Outcome" IN (FROM bad) THEN 0 ELSE 1 END AS "Class" FROM outcomes"""

_LABEL_SQL = {
    "sites": f"""WITH {_OUTCOMES} SELECT "LaunchSite", count(*) AS count FROM outcomes GROUP BY ALL""",
    "orbits": f"""WITH {_OUTCOMES} SELECT "Orbit", count(*) AS count FROM outcomes GROUP BY ALL""",
    "outcomes": f"""WITH {_OUTCOMES} SELECT "Outcome", count(*) AS count FROM outcomes GROUP BY ALL""",
    "missing": f"""WITH {_OUTCOMES} SELECT unnest(['l_orderkey', 'l_linenumber', 'l_partkey', 'LaunchSite', 'Orbit', 'Outcome']) AS "column",
        unnest([count_if(l_orderkey IS NULL), count_if(l_linenumber IS NULL), count_if(l_partkey IS NULL),
                count_if("LaunchSite" IS NULL), count_if("Orbit" IS NULL), count_if("Outcome" IS NULL)]) * 100 / count(*) AS percent
        FROM outcomes""",
    "labelled": f"""WITH {_OUTCOMES} SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber, "Class"::BIGINT AS "Class")
        FROM ({_LABELLED})""",
    "success_rate": f"""WITH {_OUTCOMES} SELECT round(avg("Class"), 2) AS success_rate FROM ({_LABELLED})""",
}
for _name, _sql in _LABEL_SQL.items():
    query(f"launch_labels_{_name}", "R8", _sql)(
        lambda t, name=_name: longs(rounded(launch_plans.launch_labelling(outcomes(t), only=[name])[name], 2)))


_ASKED = dict(site_prefix="RED", customer="BUILDING", booster="Brand#11", ground_success="A", ship_success="R",
              ship_failure="n", year="1999")
_LO, _HI = datetime.date(1996, 6, 4), datetime.date(1999, 3, 20)
_QUESTION_SQL = {
    "sites": 'SELECT DISTINCT "Launch_Site" FROM launches',
    "first_at_site": """SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber) FROM launches
        WHERE "Launch_Site" ILIKE 'RED%' ORDER BY ALL LIMIT 5""",
    "mass_for_customer": """SELECT sum("Payload_Mass") AS "Total_Payload_Mass" FROM launches WHERE "Customer" = 'BUILDING'""",
    "mean_mass_of_booster": """SELECT round(avg("Payload_Mass"), 4) AS "Average_Payload_Mass" FROM launches
        WHERE "Booster_Version" = 'Brand#11'""",
    "first_ground_success": """SELECT min("Date") AS "First_Success" FROM launches WHERE "Landing_Outcome" = 'A'""",
    "boosters_in_mass_range": """SELECT DISTINCT "Booster_Version" FROM launches
        WHERE "Landing_Outcome" = 'R' AND "Payload_Mass" > 20 AND "Payload_Mass" < 40""",
    "mission_outcomes": 'SELECT "Mission_Outcome", count(*) AS "Outcome_Count" FROM launches GROUP BY ALL',
    "boosters_at_max_mass": """SELECT DISTINCT "Booster_Version" FROM launches
        WHERE "Payload_Mass" = (SELECT max("Payload_Mass") FROM launches)""",
    "ship_failures_of_year": """SELECT substr("Date"::VARCHAR, 6, 2) AS "Month", "Landing_Outcome", "Booster_Version", "Launch_Site"
        FROM launches WHERE "Landing_Outcome" ILIKE 'n%' AND substr("Date"::VARCHAR, 1, 4) = '1999'""",
    "ranked_outcomes": """SELECT "Landing_Outcome", count(*) AS "Outcome_Count" FROM launches
        WHERE "Date" >= DATE '1996-06-04' AND "Date" <= DATE '1999-03-20' GROUP BY ALL""",
}


def _ask(t: Tables, question: str):
    answers = launch_plans.launch_questions(launches(t), **_ASKED, lo=_LO, hi=_HI, mass=(20.0, 40.0))
    return longs(rounded(answers[question], 4))


def _ask_in_sql(t: Tables, question: str):
    launches(t).createOrReplaceTempView("launches_asked")
    answer = launch_plans.launch_sql(t.spark, question, "launches_asked", **_ASKED, lo=_LO, hi=_HI, mass_lo=20.0, mass_hi=40.0)
    return longs(rounded(answer, 4))


for _name, _sql in _QUESTION_SQL.items():
    query(f"launch_question_{_name}", "R9", f"WITH {LAUNCHES} {_sql}")(lambda t, name=_name: _ask(t, name))
    query(f"launch_sql_{_name}", "R9", f"WITH {LAUNCHES} {_sql}")(lambda t, name=_name: _ask_in_sql(t, name))


@query("prepared_launch_table", "R9 S5 S6", f"""
    WITH {LAUNCHES} SELECT "Mission_Outcome", count(*) AS n FROM launches WHERE "Landing_Outcome" <> 'N' GROUP BY ALL""")
def _(t: Tables):
    undated = launches(t).withColumn("Date", F.when(F.col("Landing_Outcome") != "N", F.col("Date")))
    table = launch_plans.prepare_launch_table(undated, "launches_dated", scratch_path(t.spark, "launches"))
    return table.groupBy("Mission_Outcome").agg(F.count(F.lit(1)).alias("n"))


@query("tracker_names_cleaned", "P5 R6", """
    SELECT "column", count(*) AS n FROM (SELECT unnest(['id', 'activity_date', 'fairly_active_minutes', 'lightly_active_minutes',
        'sedentary_minutes', 'very_active_minutes', 'total_steps']) AS "column" FROM (
        SELECT DISTINCT user_id, ts::DATE FROM events)) GROUP BY ALL""")
def _(t: Tables):
    from tallywork.operators.profiles import table_profile

    return table_profile(clean_column_names(daily_activity(t))).select("column", F.col("rows").alias("n"))
