import datetime

from pyspark.sql import functions as F

from conftest import rows
from tallywork.operators import aggregates as A
from tallywork.operators import profiles as Q


def sales(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2000), ("a", 3.0, 2001), ("b", None, 2000), (None, 7.0, 2000)], "k string, v double, y int")


def test_means_counts_and_sums_treat_missing_as_pandas_does(spark):
    df = sales(spark)
    assert rows(A.group_mean(df, "k", "v")) == [("a", 2.0), ("b", None)]
    assert rows(A.group_mean(df, "k", "v", dropna=False)) == [(None, 7.0), ("a", 2.0), ("b", None)]
    assert rows(A.group_sum(df, "k", "v")) == [("a", 4.0), ("b", 0.0)]
    assert rows(A.group_count(df, "k", "v", "n")) == [("a", 2), ("b", 0)]
    assert rows(A.group_rows(df, "k")) == [(None, 1), ("a", 2), ("b", 1)]


def test_partial_sums_give_the_same_as_the_rows(spark):
    df = sales(spark)
    partial = A.partial_sums(df, ["k", "y"], ["v"], ["k"])
    assert rows(A.mean_of_sums(partial, "k", "v")) == rows(A.group_mean(df, "k", "v"))
    assert rows(A.sum_of_sums(partial, "y", "v")) == rows(A.group_sum(df, "y", "v"))
    assert rows(A.count_of_sums(partial, "y", "k", "n")) == rows(A.group_count(df, "y", "k", "n"))


def test_several_aggregates(spark):
    got = A.group_multi(sales(spark), "k", {"v": ["mean", "nunique"], "y": "max"})
    assert got.columns == ["k", "v_mean", "v_nunique", "y"]
    assert rows(got) == [("a", 2.0, 2, 2001), ("b", None, 0, 2000)]


def test_totals(spark):
    df = sales(spark)
    both = A.total_where(df, {"early": F.col("y") == 2000, "never": F.col("y") == 1}, "v")
    assert rows(both) == [(8.0, None)]
    assert rows(A.total_where(df, {"never": F.col("y") == 1}, "v", empty=0.0)) == [(0.0,)]
    assert rows(A.mean_where(df, F.col("y") == 2000, "v", "m")) == [(4.0,)]
    assert rows(A.first_date_where(df, F.col("v") > 2, "y", "first")) == [(2000,)]


def test_frequencies_and_shares(spark):
    df = spark.createDataFrame([("m",), ("c",), ("m",), (None,), ("d",)], "t string")
    assert rows(A.value_counts(df, "t"), True) == [("m", 2), ("c", 1), ("d", 1)]
    assert rows(A.value_counts(df, "t", dropna=False), True)[1:] == [(None, 1), ("c", 1), ("d", 1)]
    assert rows(A.value_shares(df, "t"), True) == [("m", 50.0), ("c", 25.0), ("d", 25.0)]
    shares = A.value_shares(spark.range(7).select((F.col("id") % 3).alias("t")), "t", digits=None)
    assert abs(sum(r[1] for r in rows(shares)) - 100) < 1e-9
    assert rows(A.share_of_total(sales(spark).na.fill(1.0), "k", "v")) == [("a", 4.0, 80.0), ("b", 1.0, 20.0)]
    empty = A.value_shares(df.filter("false"), "t")
    assert rows(empty) == []


def test_the_total_reuses_the_grouped_shuffle(spark, tmp_path):
    spark.range(100).select((F.col("id") % 4).alias("t")).write.parquet(f"{tmp_path}/t")
    shares = A.value_shares(spark.read.parquet(f"{tmp_path}/t"), "t")
    shares.collect()
    assert "ReusedExchange" in shares._jdf.queryExecution().executedPlan().toString()


def test_ranked_counts_have_inclusive_bounds_and_stable_ties(spark):
    d = datetime.date
    df = spark.createDataFrame(
        [("x", d(2010, 6, 4)), ("y", d(2017, 3, 20)), ("y", d(2012, 1, 1)), ("z", d(2013, 1, 1)), ("z", d(2017, 3, 21))],
        "o string, day date")
    ranked = A.ranked_counts_between(df, "o", "day", d(2010, 6, 4), d(2017, 3, 20))
    assert rows(ranked, True) == [("y", 2), ("x", 1), ("z", 1)]


def test_pivot_success_distinct(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 1, 4.0), ("s", 2, 1.0), (None, 1, 5.0)], "row string, col int, v double")
    assert rows(A.pivot_mean(df, "row", "col", "v", [1, 2, 3])) == [("r", 3.0, None, None), ("s", None, 1.0, None)]
    assert rows(A.success_rate(spark.createDataFrame([(1,), (0,), (1,), (1,)], "c int"), "c")) == [(0.75,)]
    assert rows(A.distinct_values(df, "row")) == [(None,), ("r",), ("s",)]


def messy(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 1.0), (None, "a", 2.0), (None, "a", 2.0), (None, "a", 2.0), (3, None, 4.0)],
        "i int, s string, x double")


def test_profiles(spark):
    df = messy(spark)
    assert rows(Q.null_counts(df)) == [("i", 3), ("s", 1), ("x", 0)]
    assert [(c, round(p, 2)) for c, p in rows(Q.null_percent(df))] == [("i", 50.0), ("s", 16.67), ("x", 0.0)]
    assert rows(Q.distinct_counts(df)) == [("i", 2), ("s", 1), ("x", 3)]
    assert rows(Q.distinct_counts(df, chunk=1)) == rows(Q.distinct_counts(df)) == rows(Q.distinct_counts(df, approx=True))
    assert rows(Q.n_distinct(df, "i")) == [(3,)] and rows(Q.n_distinct(df, "x")) == [(3,)]
    assert rows(Q.duplicate_count(df)) == [(3,)]
    assert rows(Q.duplicate_count(df, ["s"])) == [(4,)]
    assert rows(Q.duplicate_count(df.distinct())) == [(0,)]
    assert rows(Q.duplicate_count(df.filter("false"))) == [(0,)]
    assert rows(Q.null_counts(df.filter("false"))) == [("i", 0), ("s", 0), ("x", 0)]


def test_distinct_counts_of_all_types_from_one_scan(spark, tmp_path):
    df = spark.range(3000).select(
        (F.col("id") % 1000 - 500).alias("dense"), (F.col("id") % 700 * 9_000_000_007_000_000).alias("scattered"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 90).cast("byte").alias("small"), (F.col("id") % 2 == 0).alias("flag"),
        F.date_add(F.lit("1969-12-01").cast("date"), (F.col("id") % 77).cast("int")).alias("day"),
        F.timestamp_micros(F.col("id") % 130 - 65).alias("at"),
        (F.col("id") % 8).cast("decimal(9,2)").alias("money"),
        F.when(F.col("id") == 0, float("nan")).when(F.col("id") == 1, -0.0).when(F.col("id") == 2, 0.0).otherwise(
            F.col("id") % 5 + 0.5).alias("x"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("a b"), F.col("id") % 33)).otherwise("").alias("text"),
        F.to_binary(F.lit("ff00"), F.lit("hex")).alias("bytes"), F.lit(None).cast("string").alias("nothing"),
        F.array(F.col("id") % 6).alias("list"), F.col("id").alias("run"))
    df.write.parquet(f"{tmp_path}/all")
    stored = spark.read.parquet(f"{tmp_path}/all")
    got = Q.distinct_counts(stored, one_scan=True)
    assert rows(got) == rows(Q.distinct_counts(stored))
    assert dict(rows(got))["dense"] == 1000 and dict(rows(got))["x"] == 7 and dict(rows(got))["nothing"] == 0
    assert rows(Q.distinct_counts(df.filter("false"), one_scan=True)) == sorted((c, 0) for c in df.columns)
    plan = Q.distinct_counts(stored.drop("list"), one_scan=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(no") == 2
    assert "ObjectHashAggregate" in plan and "BatchEvalPython" not in plan


def test_distinct_counts_keep_the_ends_of_whole_numbers(spark):
    ends = [-2**63, 2**63 - 1, -1, 0, 63, 64, -64, -65]
    df = spark.createDataFrame([(i,) for i in ends + ends], "i long")
    assert rows(Q.distinct_counts(df, one_scan=True)) == [("i", 8)]


def test_describe_matches_pandas(spark):
    import pandas as pd

    frame = pd.DataFrame({"x": [1.0, 2.0, 4.0, 8.0, None], "c": [5.0] * 5})
    got = {r["column"]: r for r in Q.describe(spark.createDataFrame(frame).replace(float("nan"), None)).collect()}
    want = frame.describe()
    for col in frame:
        for mine, theirs in {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%",
                             "q75": "75%", "max": "max"}.items():
            assert abs(got[col][mine] - want[col][theirs]) < 1e-9, (col, mine)


def test_table_profile(spark):
    got = rows(Q.table_profile(messy(spark)))
    assert got == [(0, "i", "int", 3, 6, 3), (1, "s", "string", 5, 6, 3), (2, "x", "double", 6, 6, 3)]
