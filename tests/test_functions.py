from pyspark.sql import functions as F

from conftest import day, rows, ts
from tallywork.functions import dates as D
from tallywork.functions import scalars as S


def one(spark, schema, data, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_parse_timestamp_gives_null_for_bad_text(spark):
    got = one(spark, "t string", [("2023-01-31 23:59:59",), ("nonsense",), (None,)], D.parse_timestamp(F.col("t")))
    assert got == [(ts("2023-01-31 23:59:59"),), (None,), (None,)]


def test_american_dates(spark):
    data = [("4/12/2016 12:00:00 AM",), ("4/12/2016 12:30:00 PM",), ("13/45/2016 1:00:00 AM",)]
    got = one(spark, "t string", data, D.parse_month_day_year_time(F.col("t")))
    assert got == [(ts("2016-04-12"),), (ts("2016-04-12 12:30:00"),), (None,)]
    got = one(spark, "t string", [("4/12/2016",), ("12/4/2016",), ("",)], D.parse_month_day_year(F.col("t")))
    assert got == [(day("2016-04-12"),), (day("2016-12-04"),), (None,)]


def test_calendar_fields(spark):
    fields = D.calendar_columns(F.col("t"))
    got = one(spark, "t timestamp", [(ts("2023-12-31 08:00:00"),)], *[c.alias(n) for n, c in fields.items()],
              D.weekday_number(F.col("t")))
    assert got == [("Sunday", 31, 12, "December", 2023, 1)]


def test_minutes_truncate_toward_zero(spark):
    data = [(ts("2023-01-01 10:00:00"), ts(t)) for t in
            ("2023-01-01 10:00:30", "2023-01-01 10:01:00", "2023-01-01 09:59:30", "2023-01-01 09:58:01", "2023-01-02 10:00:59")]
    a, b = F.col("a"), F.col("b")
    got = one(spark, "a timestamp, b timestamp", data, D.whole_minutes(a, b), D.elapsed_minutes(a, b))
    assert [g[0] for g in got] == [0, 1, 0, -1, 1440]
    assert [round(g[1], 4) for g in got] == [0.5, 1.0, -0.5, -1.9833, 1440.9833]


def test_zone_free_minutes_know_no_daylight_shift(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        data = [("2023-03-12 01:30:00", "2023-03-12 03:30:00")]
        df = spark.createDataFrame(data, "a string, b string").select(
            F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        assert rows(df.select(D.whole_minutes(F.col("a"), F.col("b")))) == [(120,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_round_half_even(spark):
    got = one(spark, "x double, d int", [(2.5, 0), (3.5, 0), (-2.5, 0)], S.round_half_even(F.col("x")))
    assert got == [(2.0,), (4.0,), (-2.0,)]
    got = one(spark, "x double", [(33.25,), (0.35,), (33.35,)], S.round_half_even(F.col("x"), 1))
    assert got == [(33.2,), (0.4,), (33.4,)]


def test_text_slice_from_zero_is_one_shorter(spark):
    got = one(spark, "t string", [("2015-06-04",)], S.text_slice(F.col("t"), 1, 4), S.text_slice(F.col("t"), 0, 5),
              S.text_slice(F.col("t"), 6, 2))
    assert got == [("2015", "2015", "06")]


def test_flag_and_text(spark):
    data = [(True, "ASDS"), (False, "Ocean"), (None, None), (True, None)]
    got = one(spark, "b boolean, t string", data, S.flag_and_text(F.col("b"), F.col("t")))
    assert [g[0] for g in got] == ["True ASDS", "False Ocean", "None None", "True None"]


def test_lists_json_nan_and_ratio(spark):
    data = [([5, 6], '{"k": 69}', float("nan"), 2.0), ([], "{broken", 1.5, 0.0), (None, None, None, None)]
    got = one(spark, "l array<int>, j string, x double, d double", data,
              S.list_length(F.col("l")), S.first_item(F.col("l")), S.json_field(F.col("j"), "$.k", "long"),
              S.nan_to_null(F.col("x")), S.ratio(F.lit(4.0), F.col("d")), S.fill_constant(F.col("d"), -1.0))
    assert got == [(2, 5, 69, None, 2.0, 2.0), (0, None, None, 1.5, None, 0.0), (None, None, None, None, None, -1.0)]


def test_json_fields_of_one_parse(spark):
    texts = ['{"k": 5, "t": "x", "l": [1, {"d": 2.5}]}', '{"k": "7"}', '{"k": "no"}', "{broken", "", None, '{"k": 1, "k": 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    fields = {"k": ("$.k", "long"), "t": ("$.t", "string"), "d": ("$.l[1].d", "double"), "e": ("$.e", "string")}
    got = S.with_json_fields(df, "j", fields).drop("j")
    none = (None,) * 4
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 5, "x", 2.5, None), (1, 7, None, None, None), *[(i, *none) for i in range(2, 7)]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
