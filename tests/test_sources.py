import datetime
import json
import random

import pytest

from conftest import day, rows
from tallywork import schemas
from tallywork.sources import tables as S
from tallywork.sources.html_tables import extract_html_tables, html_cells, named_table, table_headers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_table(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Date,Close\n2024-01-02,1.5\n2024-01-01,NaN\n,2\n")
    df = S.read_table(spark, path, schemas.PRICES)
    assert rows(df) == [(None, 2.0), (day("2024-01-01"), None), (day("2024-01-02"), 1.5)]
    assert dict(S.read_table(spark, path).dtypes) == {"Date": "date", "Close": "double"}
    df.write.parquet(f"{tmp_path}/p")
    assert rows(S.read_table(spark, f"{tmp_path}/p", fmt="parquet")) == rows(df)


TRIPS = """ride_id,rideable_type,started_at,ended_at,start_station_name,start_lat,member_casual
r1,classic_bike,2023-01-02 10:00:00,2023-01-02 10:20:00,Clark St,41.9,member
"""
DAYS = """Id,ActivityDate,TotalSteps,TotalDistance,VeryActiveMinutes,FairlyActiveMinutes,LightlyActiveMinutes,SedentaryMinutes,Calories
15,4/12/2016,13162,8.5,25,13,328,728,1985
"""


def test_columns_are_bound_by_name(spark, tmp_path):
    ride = S.read_table(spark, write(tmp_path / "trips.csv", TRIPS), schemas.RIDES).collect()[0]
    assert ride["member_casual"] == "member" and ride["ended_at"] - ride["started_at"] == datetime.timedelta(minutes=20)
    daily = S.read_table(spark, write(tmp_path / "days.csv", DAYS), schemas.DAILY_ACTIVITY)
    assert rows(daily) == [(15, "4/12/2016", 13162, 13, 328, 728, 25, 1985)]
    with pytest.raises(ValueError, match="no column"):
        S.read_table(spark, write(tmp_path / "short.csv", "ride_id\nr1\n"), schemas.RIDES)


def test_files_of_different_headers(spark, tmp_path):
    one, two = write(tmp_path / "1.csv", "a,b,z\n1,x,9\n"), write(tmp_path / "2.csv", "b,a\ny,2\n")
    assert rows(S.read_many(spark, [one, two], "a int, b string")) == [(1, "x"), (2, "y")]
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,x\n")
    write(folder / "2.csv", "b,a\ny,2\n")
    write(folder / "3.csv", "")
    assert rows(S.read_table(spark, str(folder), "a int, b string")) == [(1, "x"), (2, "y")]  # each file by its own header
    assert S.read_table(spark, write(tmp_path / "none.csv", ""), "a int, b string").count() == 0


def test_many_files_cost_no_more_jobs(spark, tmp_path):
    def jobs(folder, files):
        folder.mkdir()
        for i in range(files):
            write(folder / f"trips [{i}] %20é.csv", f"a,b\n{i},x\n" if i % 3 else f'\ufeff"b, quoted",b,a\n0,y,{i}\n')
        spark.sparkContext.setJobGroup(folder.name, "")
        read = S.read_table(spark, str(folder), "a int, b string")
        assert rows(read.selectExpr("count(*)", "count(DISTINCT a)", "min(b)", "max(b)")) == [(files, files, "x", "y")]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder.name))
    few, many = jobs(tmp_path / "few", 6), jobs(tmp_path / "many", 300)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 2  # listing of many files may be a job of its own


def test_headers_of_split_files(spark, tmp_path):
    big = write(tmp_path / "big.csv", "a,b\n" + "".join(f"{i},{'x' * 50}\n" for i in range(40_000)))
    small = write(tmp_path / "small.csv", "b,a\ny,-1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = S.headers_of_files(spark, [big, small])
        assert [(line, [f.rsplit("/", 1)[1] for f in files]) for line, files in found] == [("a,b", ["big.csv"]), ("b,a", ["small.csv"])]
        assert rows(S.read_many(spark, [big, small], "a int, b string").selectExpr("count(*)", "min(a)", "max(a)")) == [(40_001, -1, 39_999)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_cells(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,b\n1,x\nnone,y\n")
    with pytest.raises(Exception):
        S.read_table(spark, path, "a int, b string").collect()
    assert rows(S.read_table(spark, path, "a int, b string", malformed="null")) == [(None, "y"), (1, "x")]
    assert rows(S.read_table(spark, path, "a int, b string", malformed="bad").select("a", "bad")) == [(None, "none,y"), (1, None)]


def test_read_many_is_one_scan_or_a_union_by_name(spark, tmp_path):
    one = write(tmp_path / "1.csv", "a,b\n1,x\n")
    two = write(tmp_path / "2.csv", "a,b\n2,y\n")
    df = S.read_many(spark, [one, two], "a int, b string")
    assert rows(df) == [(1, "x"), (2, "y")]
    assert "Union" not in df._jdf.queryExecution().executedPlan().toString()
    three = write(tmp_path / "3.csv", "c,a\n0.5,3\n")
    assert rows(S.read_many(spark, [one, three])) == [(1, "x", None), (3, None, 0.5)]


def test_json_records(spark, tmp_path):
    records = [{"id": 1, "links": {"a": "x", "b": None}, "cores": [{"core": "c1"}]}, {"id": 2, "links": None, "cores": []}]
    path = write(tmp_path / "r.json", json.dumps(records, indent=1))
    schema = "id int, links struct<a: string, b: string>, cores array<struct<core: string>>"
    df = S.read_json_records(spark, path, schema)
    assert df.columns == ["id", "links_a", "links_b", "cores"]
    assert [(r["id"], r["links_a"], len(r["cores"])) for r in df.collect()] == [(1, "x", 1), (2, None, 0)]
    assert S.read_json_records(spark, path, flatten=False).columns == ["cores", "id", "links"]


@pytest.mark.parametrize("split", ["128m", "20k", "900"])
def test_json_arrays_in_parts(spark, tmp_path, split):
    rng = random.Random(2)
    texts = ["plain", "a}b{", 'q"}', "back\\", '\\"}{[', "}]", "é}語", "", None]
    made, folder = [], tmp_path / "arrays"
    folder.mkdir()
    for file, (count, indent) in enumerate([(700, None), (300, 1), (0, None), (1, None), (40, 0)]):
        some = [{"id": 1000 * file + i, "s": rng.choice([*texts, "x" * rng.randrange(900)]), "l": [{"k": [1, [{"z": "}"}]]}] * rng.randrange(3)}
                for i in range(count)]
        made += some
        write(folder / f"{file}.json", "\n " * (file % 2) + json.dumps(some, indent=indent, ensure_ascii=bool(file % 2)) + "\n" * (file % 2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        schema = "id int, s string, l array<struct<n: int>>"
        got = S.read_json_array(spark, str(folder), schema).collect()
        assert sorted((r["id"], r["s"], len(r["l"])) for r in got) == sorted(((r["id"], r["s"], len(r["l"])) for r in made))
        assert sorted(got, key=str) == sorted(S.read_json_records(spark, str(folder), schema).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_what_is_no_json_array(spark, tmp_path):
    path = write(tmp_path / "cut.json", '[{"id": 1}, {"id": 2}, {"id": ')
    with pytest.raises(Exception):
        S.read_json_array(spark, path, "id int").collect()
    assert rows(S.read_json_array(spark, path, "id int", mode="PERMISSIVE")) == [(None,), (1,), (2,)]
    assert S.read_json_array(spark, write(tmp_path / "none.json", " [ ]\n"), "id int").count() == 0


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    path = write(tmp_path / "one.json", json.dumps([{"id": i, "t": "y" * 100} for i in range(40_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        found = S.array_records(spark, path)
        assert found.selectExpr("count(*)", "count(DISTINCT text)").first() == (40_000, 40_000)
        assert len({f for f in found.inputFiles()}) >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, day("2024-01-01")), (2, None)], "id int, Date date")
    S.load_table(df, "loaded")
    with pytest.raises(Exception, match="already exists"):
        S.load_table(df, "loaded", mode="fail")
    S.load_table(df, "stored_once", stored=True, path=f"{tmp_path}/once")
    S.drop_table(spark, "kept")
    S.drop_table(spark, "kept")  # dropping what is not there is fine
    kept = S.create_table_as(spark, "kept", "SELECT * FROM loaded WHERE Date IS NOT NULL", f"{tmp_path}/kept")
    assert rows(kept) == [(1, datetime.date(2024, 1, 1))]
    again = S.create_table_as(spark, "kept", df, f"{tmp_path}/kept2")
    assert again.count() == 2 and spark.table("stored_once").count() == 2
    S.drop_table(spark, "kept")
    S.drop_table(spark, "stored_once")
    assert not spark.catalog.tableExists("kept")


def test_write_csv_with_and_without_row_numbers(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "i int, s string").repartition(3)
    S.write_csv(df, f"{tmp_path}/plain")
    assert rows(S.read_table(spark, f"{tmp_path}/plain", "i int, s string")) == [(1, "a"), (2, None), (3, "c")]
    S.write_csv(df, f"{tmp_path}/numbered", row_ids=["i"], start=1)
    back = S.read_table(spark, f"{tmp_path}/numbered", "_row long, i int, s string")
    assert rows(back) == [(1, 1, "a"), (2, 2, None), (3, 3, "c")]


def test_write_parquet_in_folders(spark, tmp_path):
    df = spark.createDataFrame([(2023, 1, "a"), (2024, 2, "b")], "year int, month int, v string")
    S.write_parquet(df, f"{tmp_path}/p", ["year", "month"])
    back = spark.read.parquet(f"{tmp_path}/p").filter("year = 2024")
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 1


def test_price_series(spark):
    df = spark.createDataFrame([("2024-01-03", 3.0, 1), ("2024-01-01", 1.0, 1)], "Date string, Close double, Volume int")
    assert rows(S.price_series(df, "Date", "Close"), True) == [(day("2024-01-01"), 1.0), (day("2024-01-03"), 3.0)]


PAGES = [
    (1, "<p>no table</p>"),
    (2, "<table><tr><th>Date</th><th>Revenue</th></tr><tr><td>2020</td><td>$1 &amp; <b>2</b></td></tr></table>"),
    (3, "<table><tr><td>first</td></tr></table>text<TABLE><tbody><tr><td>a<br>b<td>  c \n d</tr><tr><td>only</td></tr></tbody></TABLE>"),
    (4, "<table><tr><td>open<table><tr><td>inner</td></tr></table>tail</td></tr><tr><td>never closed"),
    (5, None),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id int, html string")


def test_html_cells(spark):
    got = [tuple(r) for r in html_cells(pages(spark), "html", "page_id").orderBy("page_id", "table_no", "row_no", "col_no").collect()]
    assert got == [
        (2, 0, 0, 0, True, "Date"), (2, 0, 0, 1, True, "Revenue"), (2, 0, 1, 0, False, "2020"), (2, 0, 1, 1, False, "$1 & 2"),
        (3, 0, 0, 0, False, "first"),
        (3, 1, 0, 0, False, "a b"), (3, 1, 0, 1, False, "c d"), (3, 1, 1, 0, False, "only"),
        (4, 0, 0, 0, False, "opentail"), (4, 0, 1, 0, False, "never closed"), (4, 1, 0, 0, False, "inner"),
    ]


def test_html_tables(spark):
    got = rows(extract_html_tables(pages(spark), "html", "page_id", 1, ["x", "y"]))
    assert got == [(3, 0, "a b", "c d"), (3, 1, "only", None), (4, 0, "inner", None)]
    got = rows(extract_html_tables(pages(spark), "html", "page_id", 0, ["date", "revenue"]))
    assert (2, 1, "2020", "$1 & 2") in got and all(r[2] != "Date" for r in got)
    listed = {(r[0], r[1]): (r[2], r[3]) for r in extract_html_tables(pages(spark), "html", "page_id", 0).collect()}
    assert listed[2, 0] == (True, ["Date", "Revenue"]) and listed[3, 0] == (False, ["first"])
    assert rows(table_headers(pages(spark), "html", "page_id", 0)) == [(2, 0, "Date"), (2, 1, "Revenue")]


def test_spans_and_header_names(spark):
    html = ("<table><tr><th>Date<th>Revenue<th><th>Revenue</tr><tr><td rowspan=2>x</td><td>1</td><td colspan='2'>2</td></tr>"
            "<tr><td>3</td><td>4</td></tr><tr><td rowspan=99>end</td><td colspan=bad>5</td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, "<table><tr><td>no header</td></tr></table>")], "page_id int, html string")
    got = {(r["row_no"], r["col_no"]): r["text"] for r in html_cells(df.filter("page_id = 1"), "html", "page_id").collect()}
    assert [got.get((1, c)) for c in range(4)] == ["x", "1", "2", "2"] and [got.get((2, c)) for c in range(3)] == ["x", "3", "4"]
    assert got[3, 0] == "end" and (4, 0) not in got
    named = {r["row_no"]: r["entries"] for r in named_table(df, "html", "page_id", 0).collect()}
    assert named == {1: {"Date": "x", "2": "2", "Revenue": "2"}, 2: {"Date": "x", "Revenue": "3", "2": "4"}, 3: {"Date": "end", "Revenue": "5"}}


def test_executors_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tallywork.operators import stats
    from tallywork.sources import html_tables

    tasks = [html_tables._cells, stats._replicate_sums(["k"], 10)]
    (tmp_path / "task").write_bytes(cloudpickle.dumps(tasks))
    code = "import pickle; f, g = pickle.load(open('task', 'rb')); print(f('<table><tr><td>x'), next(g(iter([])), 'none'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.strip() == "[(0, 0, 0, False, 'x')] none", out.stderr
