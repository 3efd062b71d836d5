"""Readers and writers, fed with data that Spark writes from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.registry import Tables, longs, query
from tallywork.operators.numbering import renumber
from tallywork.session import scratch_path
from tallywork.sources import tables as S
from tallywork.sources.html_tables import extract_html_tables, html_cells

_ORDERS = """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
             o_orderdate timestamp_ntz, o_orderpriority string"""


@query("csv_scan", "S1", "SELECT * FROM orders")
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    S.write_csv(t.orders, path)
    return S.read_table(t.spark, path, _ORDERS)


@query("csv_scan_inferred", "S1", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    S.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    read = S.read_table(t.spark, path)
    return read.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("multi_file_scan", "S2", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables):
    paths = []
    for third in range(3):
        paths.append(scratch_path(t.spark, f"csv-{third}"))
        part = t.orders.filter(F.coalesce(F.pmod("o_orderkey", F.lit(3)), F.lit(0)) == third)
        S.write_csv(part.select("o_orderkey", "o_orderstatus", "o_totalprice"), paths[-1])
    return S.read_many(t.spark, paths, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("multi_file_scan_drifting", "S2 U1", """
    SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(t: Tables):
    old, new = scratch_path(t.spark, "csv-old"), scratch_path(t.spark, "csv-new")
    S.write_csv(t.orders.filter("o_orderstatus <=> 'F'").select("o_orderkey"), old)
    S.write_csv(t.orders.filter("NOT o_orderstatus <=> 'F'").select("o_orderpriority", "o_orderkey"), new)
    read = S.read_many(t.spark, [old, new])
    return read.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")


@query("csv_columns_by_name", "S1", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t: Tables):
    """The file has more columns, in another order, than the schema asks for."""
    path = scratch_path(t.spark, "csv")
    S.write_csv(t.orders.select("o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey", "o_totalprice"), path)
    return S.read_table(t.spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string")


@query("multi_file_columns_by_name", "S2", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t: Tables):
    """Each file has its own order of columns."""
    orders = [["o_orderkey", "o_custkey", "o_totalprice"], ["o_totalprice", "o_orderstatus", "o_orderkey", "o_custkey"]]
    paths = []
    for half, columns in enumerate(orders):
        paths.append(scratch_path(t.spark, f"csv-{half}"))
        S.write_csv(t.orders.filter(F.coalesce(F.pmod("o_orderkey", F.lit(2)), F.lit(0)) == half).select(*columns), paths[-1])
    return S.read_many(t.spark, paths, "o_orderkey long, o_custkey long, o_totalprice double")


_EVENT = "event_id long, who struct<user: long, type: string>"


def _array_files(t: Tables) -> str:
    """Files that hold one JSON array each, of ten thousand records at most."""
    path = scratch_path(t.spark, "json-array")
    record = F.to_json(F.struct("event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")).alias("who")))
    arrays = t.events.groupBy(F.floor(F.col("event_id") / 10_000).alias("file")).agg(F.concat(
        F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return path


@query("json_array_records", "S3 H12", """
    SELECT event_id, user_id AS who_user, event_type AS who_type FROM events""")
def _(t: Tables):
    return S.read_json_records(t.spark, f"{_array_files(t)}/*", _EVENT)


@query("json_array_in_parts", "S3 H12", """
    SELECT event_id, user_id AS who_user, event_type AS who_type FROM events""")
def _(t: Tables):
    """The same files, a file read by as many tasks as it has splits."""
    return S.read_json_array(t.spark, f"{_array_files(t)}/*", _EVENT)


@query("json_records", "S3 H12", """
    SELECT event_id, user_id AS who_user, event_type AS who_type, value FROM events""")
def _(t: Tables):
    path = scratch_path(t.spark, "json")
    nested = t.events.select("event_id", "value",
                             F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")).alias("who"))
    nested.write.json(path)
    schema = "event_id long, value double, who struct<user: long, type: string>"
    return S.read_json_records(t.spark, path, schema, multi_line=False)


# Each page's lists as tables: an item is a row with one cell. The twin takes the items apart with
# patterns; both sides drop the tags inside a cell and resolve the one entity that occurs.
@query("html_cells", "S4", """
    WITH lists AS (
        SELECT page_id, unnest(l) AS list, unnest(range(len(l))) AS table_no
        FROM (SELECT page_id, regexp_extract_all(html, '<ul[^>]*>(.*?)</ul>', 1, 's') AS l FROM pages)),
    items AS (
        SELECT page_id, table_no, unnest(i) AS item, unnest(range(len(i))) AS row_no
        FROM (SELECT page_id, table_no, regexp_extract_all(list, '<li[^>]*>(.*?)</li>', 1, 's') AS i FROM lists))
    SELECT page_id, table_no::BIGINT AS table_no, row_no::BIGINT AS row_no, 0::BIGINT AS col_no,
           trim(regexp_replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text
    FROM items""")
def _(t: Tables):
    return longs(html_cells(_lists_as_tables(t), "html", "page_id").drop("is_header"))


@query("html_table_rows", "S4", """
    SELECT page_id, (r - 1)::BIGINT AS row_no,
           trim(regexp_replace(replace(regexp_replace(i[r], '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS entry
    FROM (SELECT page_id, i, unnest(range(1, len(i) + 1)) AS r FROM (
        SELECT page_id, regexp_extract_all(regexp_extract(html, '<ul[^>]*>(.*?)</ul>', 1, 's'),
                                           '<li[^>]*>(.*?)</li>', 1, 's') AS i FROM pages))""")
def _(t: Tables):
    return longs(extract_html_tables(_lists_as_tables(t), "html", "page_id", 0, ["entry"]))


# Each list as a table whose first cell spans all rows: it takes the first column of every row.
@query("html_spanning_cells", "S4", """
    WITH lists AS (
        SELECT page_id, unnest(l) AS list, unnest(range(len(l))) AS table_no
        FROM (SELECT page_id, regexp_extract_all(html, '<ul[^>]*>(.*?)</ul>', 1, 's') AS l FROM pages)),
    items AS (
        SELECT page_id, table_no, unnest(i) AS item, unnest(range(len(i))) + 1 AS row_no
        FROM (SELECT page_id, table_no, regexp_extract_all(list, '<li[^>]*>(.*?)</li>', 1, 's') AS i FROM lists)),
    cells AS (
        SELECT page_id, table_no, 0 AS row_no, 1 AS col_no, 'first' AS text FROM lists
        UNION ALL SELECT page_id, table_no, 0, 0, 'list' FROM lists
        UNION ALL SELECT page_id, table_no, row_no, 0, 'list' FROM items
        UNION ALL SELECT page_id, table_no, row_no, 1,
            trim(regexp_replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) FROM items)
    SELECT page_id, table_no::BIGINT AS table_no, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no, text FROM cells""")
def _(t: Tables):
    opened = "<table><tr><td rowspan='65534'>list</td><td>first</td></tr>"
    return longs(html_cells(_lists_as_tables(t, opened), "html", "page_id").drop("is_header"))


def _lists_as_tables(t: Tables, opened: str = "<table>"):
    html = F.col("html")
    for old, new in (("<ul[^>]*>", opened), ("</ul>", "</table>"), ("<li[^>]*>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.regexp_replace(html, old, new)
    return t.pages.select("page_id", html.alias("html"))


@query("stored_table", "S5 S6", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(t: Tables):
    loaded = t.orders.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    S.load_table(loaded, "orders_loaded")
    S.drop_table(t.spark, "orders_kept")
    return S.create_table_as(
        t.spark, "orders_kept", "SELECT o_orderkey, o_totalprice FROM orders_loaded WHERE o_orderpriority IS NOT NULL",
        path=scratch_path(t.spark, "table"))


@query("loaded_view", "S5", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables):
    S.load_table(t.supplier, "suppliers_loaded")
    return t.spark.sql("SELECT s_suppkey, s_name FROM suppliers_loaded")


@query("csv_export_numbered", "S7 P17", """
    SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS _row, c_custkey, c_acctbal FROM customer""")
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    S.write_csv(t.customer.select("c_custkey", "c_acctbal"), path, row_ids=["c_acctbal", "c_custkey"])
    return S.read_table(t.spark, path, "_row long, c_custkey long, c_acctbal double")


@query("price_series", "S8 O1", """
    WITH prices AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS close FROM orders GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY date) AS position FROM prices""")
def _(t: Tables):
    daily = t.orders.groupBy("o_orderdate").agg(F.max("o_totalprice").alias("Close"))
    return renumber(S.price_series(daily, "o_orderdate", "Close"), ["date"], "position")
