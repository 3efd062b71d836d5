"""What must hold at any size: results under any partitioning, hot keys spread, plans without traps."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallywork.catalog import QUERIES
from tallywork.operators.numbering import PART, renumber, store_in_order
from tallywork.session import drop_scratch, scratch_root, write_scratch

FOLDER = "/root/testdata/sf0.001"
# one of each kind of plan: joins, completion, shares, distinct, quantiles, numbering, scores, windows in time
SAMPLE = ["mean_ride_length", "merge_three_tables", "merge_with_hot_key", "value_shares", "distinct_counts", "describe_columns",
          "group_quantiles", "box_summary", "renumber_rows", "rank_by_count", "collect_launches", "traffic_spikes",
          "credential_stuffing", "classification_report", "launch_labels_labelled", "activity_hourly", "merge_stored_tables",
          "ride_distinct_counts"]


@pytest.mark.parametrize("name", SAMPLE)
def test_partitioning_does_not_matter(spark, name):
    results = []
    try:
        for partitions, coalesce in ((1, "true"), (37, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            results.append(rows(QUERIES[name](spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1]


@pytest.mark.parametrize("name", SAMPLE)
def test_shuffle_joins_give_the_same(spark, name):
    """No query may depend on a broadcast that the data outgrow."""
    want = rows(QUERIES[name](spark, FOLDER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(QUERIES[name](spark, FOLDER)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)


def test_adaptive_execution_splits_a_skewed_merge(spark):
    from tallywork.operators.joins import merge_all

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k")
        a = spark.range(0, 40000, 1, 16).select(key, F.col("id").alias("a"))
        b = spark.range(0, 40001, 1, 4).filter("id = 0 or id % 2 = 1").select(F.col("id").alias("k"), F.hash("id").alias("b"))
        c = b.select("k", F.col("b").alias("c"))
        merged = merge_all([a, b, c], ["k"])
        assert merged.count() == 40000
        merged = merged.agg(F.sum("a"))
        assert rows(merged) == [(sum(range(40000)),)]
        assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_a_repeated_order_value_is_split(spark):
    df = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") < 15000, 1).otherwise(2).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = store_in_order(df, ["k", F.xxhash64("k", "id")], "ties")
        sizes = [r["count"] for r in placed.groupBy(PART).count().collect()]
        assert len(sizes) >= 7 and max(sizes) < 2 * 20000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first, second = (rows(renumber(df.repartition(n), ["k"], "n")) for n in (2, 11))
    assert first == second and sorted(n for _, _, n in first) == list(range(1, 20001))
    assert all((k == 1) == (n <= 15000) for k, _, n in first)


def test_scratch(spark):
    kept = write_scratch(spark.range(5), "five")
    assert kept.count() == 5
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    drop_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(kept.inputFiles()[0])
