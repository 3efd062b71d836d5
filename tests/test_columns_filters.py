import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallywork.operators import columns as C
from tallywork.operators import filters as P


def test_drop_columns_rejects_unknown_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.drop_columns(df, ["b"]).columns == ["a"]
    with pytest.raises(ValueError, match="unknown columns"):
        C.drop_columns(df, ["c"])


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["ActivityHour", "Activity Hour", "% Active", "2nd"])
    assert C.clean_column_names(df).columns == ["activity_hour", "activity_hour_2", "percent_active", "x2nd"]
    assert C.lowercase_columns(df).columns == ["activityhour", "activity hour", "% active", "2nd"]
    assert C.rename_columns(df, {"2nd": "second"}).columns[-1] == "second"
    assert [C.snake_case(n) for n in ("BMI", "IsManualReport", "WeightKg")] == ["bmi", "is_manual_report", "weight_kg"]


def test_cast_truncates_and_tolerates(spark):
    df = spark.createDataFrame([(1.9, "7"), (-1.9, "x")], "a double, b string")
    assert rows(C.cast_columns(df.select("a"), {"a": "int"})) == [(-1,), (1,)]
    assert rows(C.cast_columns(df.select("b"), {"b": "int"}, strict=False)) == [(None,), (7,)]


def test_recode_and_label(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("maybe",), (None,)], "a string")
    assert rows(C.recode(df, "a", {"Yes": 1, "No": 0}, "n")) == [(None, None), ("No", 0), ("Yes", 1), ("maybe", None)]
    assert rows(C.recode(df, "a", {}, "n", default=9)) == [(None, 9), ("No", 9), ("Yes", 9), ("maybe", 9)]
    labelled = C.label_membership(df, "a", ["No"], "class")
    assert rows(labelled) == [(None, 1), ("No", 0), ("Yes", 1), ("maybe", 1)]


def test_nans_become_nulls(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int")
    assert rows(C.nulls_for_nans(df)) == [(None, 1), (2.0, 2)]


def test_ranges(spark):
    df = spark.createDataFrame([(4000.0,), (5000.0,), (6000.0,), (None,)], "m double")
    assert rows(P.filter_between(df, "m", 4000.0, 6000.0, inclusive=False)) == [(5000.0,)]
    assert len(rows(P.filter_between(df, "m", 4000.0, 6000.0))) == 3
    assert rows(P.filter_between(df, "m", hi=4500.0)) == [(4000.0,)]
    days = spark.createDataFrame([(datetime.date(2010, 6, 4),), (datetime.date(2017, 3, 21),)], "d date")
    kept = P.filter_between(days, "d", datetime.date(2010, 6, 4), datetime.date(2017, 3, 20))
    assert rows(kept) == [(datetime.date(2010, 6, 4),)]


def test_prefix(spark):
    df = spark.createDataFrame([("CCAFS",), ("cca x",), ("KSC",), (None,), ("C%A",)], "s string")
    assert rows(P.filter_prefix(df, "s", "CCA")) == [("CCAFS",), ("cca x",)]
    assert rows(P.filter_prefix(df, "s", "CCA", ignore_case=False)) == [("CCAFS",)]
    assert rows(P.filter_prefix(df, "s", "C%")) == [("C%A",)]


def test_missing_values_in_filters(spark):
    df = spark.createDataFrame([("Falcon 1", 1), ("Falcon 9", None), (None, 3)], "name string, n int")
    assert rows(P.filter_not_equal_keep_null(df, "name", "Falcon 1")) == [(None, 3), ("Falcon 9", None)]
    assert rows(P.filter_compare(df, "name", "!=", "Falcon 1")) == [("Falcon 9", None)]
    assert rows(P.filter_not_null(df, "n")) == [(None, 3), ("Falcon 1", 1)]
    assert rows(P.drop_incomplete_rows(df)) == [("Falcon 1", 1)]
    assert rows(P.filter_equals(df, {"name": "Falcon 1", "n": 1})) == [("Falcon 1", 1)]


def test_list_size(spark):
    df = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, []), (4, None)], "id int, l array<int>")
    assert rows(P.filter_array_size(df, "l", 1).select("id")) == [(1,)]


def test_simple_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("string").alias("s"), F.lit(1).alias("z")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    kept = P.filter_prefix(P.filter_between(df, "id", 3, 30), "s", "2", ignore_case=False).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "StringStartsWith(s,2)" in plan
    assert "ReadSchema: struct<id:bigint,s:string>" in plan
