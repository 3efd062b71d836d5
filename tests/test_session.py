"""The scratch area in sessions of their own, without a folder set beforehand."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
JOB = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from tallywork.operators.numbering import renumber
from tallywork.operators.quantiles import quantiles
from tallywork.plans.cars import yearly_report
from tallywork.session import SCRATCH_SETTING, scratch, scratch_root
from tallywork.streaming import monitor
from tallywork import schemas
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.warehouse.dir", "warehouse").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
print("preset", spark.conf.get("spark.checkpoint.dir", None))
with scratch(spark):
    folder = spark.conf.get(SCRATCH_SETTING)
    numbers = spark.range(100).withColumn("k", F.col("id") % 2)
    assert renumber(numbers, ["id"], "n").agg(F.max("n")).first()[0] == 100
    assert quantiles(numbers, "id", (0.5,)).count() == 1
    cars = spark.createDataFrame([(2000, "1", 0, "a", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], schemas.CAR_SALES)
    assert yearly_report(cars, 2000)["sales_by_year"].count() == 1
    spark.range(5).select("id", F.current_timestamp().alias("ts")).write.parquet("events")
    stream = monitor.read_event_stream(spark, "events", "id long, ts timestamp")
    assert monitor.run_available(monitor.deduplicate(stream, "id", "ts", "1 day"), "s").count() == 5
    assert os.path.isdir(folder.removeprefix("file:"))
assert not os.path.exists(folder.removeprefix("file:"))
print("fine", scratch_root(spark) != folder)
"""


def test_scratch_without_a_preset_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    run = subprocess.run(
        [sys.executable, "-c", JOB.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True,
        env={**__import__("os").environ, "SPARK_CONF_DIR": str(tmp_path / "conf")})
    assert "preset None" in run.stdout and "fine True" in run.stdout, run.stdout + run.stderr[-3000:]
