from pyspark.sql import functions as F

from conftest import rows
from tallywork.operators import joins as J
from tallywork.operators.sets import drop_duplicate_rows, union_all


def test_merge_matches_missing_keys_and_suffixes_clashes(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (3, "z", 30)], "id int, h string, v int")
    b = spark.createDataFrame([(1, "x", 11), (None, "y", 21), (1, "y", 99)], "id int, h string, v int")
    merged = J.merge_inner(a, b, ["id", "h"])
    assert merged.columns == ["id", "h", "v_x", "v_y"]
    assert rows(merged) == [(None, "y", 20, 21), (1, "x", 10, 11)]
    assert rows(J.merge_inner(a, b, ["id", "h"], na_matches=False)) == [(1, "x", 10, 11)]


def test_merge_all_keeps_common_keys_only(spark):
    frames = [spark.createDataFrame(d, f"id int, hour string, {n} int") for n, d in {
        "a": [(1, "1 AM", 1), (1, "2 AM", 2)], "b": [(1, "1 AM", 5), (2, "1 AM", 6)], "c": [(1, "1 AM", 9)]}.items()]
    merged = J.merge_all(frames, ["id", "hour"])
    assert merged.columns == ["id", "hour", "a", "b", "c"] and rows(merged) == [(1, "1 AM", 1, 5, 9)]


def test_spreading_a_hot_key_changes_no_row(spark):
    # one key holds most of the rows of both sides; a missing key and a lonely key besides
    left = spark.range(600).select(
        F.when(F.col("id") < 400, 1).when(F.col("id") < 405, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("l"))
    right = spark.range(410).select(
        F.when(F.col("id") < 5, 1).when(F.col("id") < 7, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    plain = rows(J.merge_inner(left, right, ["k"]))
    assert len(plain) > 2000
    assert rows(J.merge_inner(left, right, ["k"], hot_share=0.2, salts=7)) == plain
    assert rows(J.merge_inner(left, right, ["k"], hot_share=0.2, na_matches=False)) == [r for r in plain if r[0] is not None]
    assert rows(J.hot_keys(left, ["k"], 0.2)) == [(1,)]


def _three(spark):
    """A key with a third of the rows, missing keys and rows of one key part missing, repeated rows, lonely keys."""
    ids = spark.range(300)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 80).alias("k")
    part = F.when(F.col("id") % 50 == 2, F.lit(None)).otherwise(F.concat(F.lit("p"), F.col("id") % 3)).alias("h")
    return {
        "stored_a": ids.select(key, part, F.col("id").alias("v"), F.lit("a").alias("a")),
        "stored_b": ids.filter("id % 30 < 4").select(key, part, (F.col("id") + 1).alias("v"), F.lit(1).alias("b")),
        "stored_c": ids.filter("id < 12 or id > 290").select(part, key, F.lit(2.5).alias("c"))}


def test_stored_tables_merge_as_the_tables_do(spark, tmp_path):
    keys = ["k", "h"]
    frames = _three(spark)
    J.store_for_merges(frames, keys, 5, hot_share=0.1, folder=f"{tmp_path}/t")
    for na_matches in (True, False):
        want = rows(J.merge_all(list(frames.values()), keys, na_matches=na_matches))
        merged = J.merge_stored(spark, list(frames), keys, na_matches)
        assert merged.columns == ["k", "h", "v_x", "a", "v_y", "b", "c"] and rows(merged) == want
    assert len(want) > 1000
    assert sum(spark.table(n + s).count() for n in frames for s in ("", "_apart")) == sum(f.count() for f in frames.values())
    assert spark.table("stored_a").filter("k = 7 and h = 'p0' or k is null or h is null").count() == 0
    J.store_for_merges({n: f.filter("false") for n, f in frames.items()}, keys, 5, folder=f"{tmp_path}/empty")
    assert rows(J.merge_stored(spark, list(frames), keys)) == []


def test_buckets_meet_without_an_exchange(spark, tmp_path):
    frames = _three(spark)
    J.store_for_merges(frames, ["k", "h"], 5, hot_share=0.1, folder=f"{tmp_path}/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = J.merge_all([spark.table(n) for n in frames], ["k", "h"], na_matches=False)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert dealt.rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_enrich_keeps_every_fact(spark):
    facts = spark.createDataFrame([(1, "r1"), (2, "r9"), (3, None)], "flight int, rocket string")
    dim = spark.createDataFrame([("r1", "Falcon 9", 0)], "id string, name string, extra int")
    assert rows(J.enrich(facts, dim, "rocket", "id", {"name": "Booster"})) == [
        (1, "r1", "Falcon 9"), (2, "r9", None), (3, None, None)]


def test_complete_categories(spark):
    grouped = spark.createDataFrame(
        [("member", "Monday", 3.0), ("casual", "Sunday", 4.0), ("casual", "Someday", 5.0), (None, "Sunday", None)],
        "rider string, day string, length double")
    full = J.complete_categories(grouped, ["rider"], "day", ["Sunday", "Monday"])
    assert full.columns == ["rider", "day", "length"]
    assert rows(full) == [(None, "Monday", None), (None, "Sunday", None), ("casual", "Monday", None),
                          ("casual", "Sunday", 4.0), ("member", "Monday", 3.0), ("member", "Sunday", None)]


def test_completion_scans_the_facts_once(spark, tmp_path):
    spark.range(50).select((F.col("id") % 3).alias("k"), F.lit("a").alias("c"), "id").write.parquet(f"{tmp_path}/f")
    grouped = spark.read.parquet(f"{tmp_path}/f").groupBy("k", "c").agg(F.avg("id").alias("m"))
    plan = J.complete_categories(grouped, ["k"], "c", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_rows_at_extreme_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("b", 9), ("d", None)], "v string, m int")
    assert rows(J.rows_at_extreme(df, "m", cols=["v"])) == [("b",), ("c",)]
    assert len(rows(J.rows_at_extreme(df, "m"))) == 3
    assert rows(J.rows_at_extreme(df, "m", "min")) == [("a", 5)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2), ("y", 2)], "s string, i int")
    c = spark.createDataFrame([(3,)], "i int")
    assert rows(union_all([a, b, c])) == [(1, "x"), (2, "y"), (2, "y"), (3, None)]
    d = spark.createDataFrame([(1, None), (1, None), (1, "x")], "i int, s string")
    assert rows(drop_duplicate_rows(d)) == [(1, None), (1, "x")]
