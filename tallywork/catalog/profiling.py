"""Profiles of whole tables."""

from __future__ import annotations

from tallywork.catalog.inputs import GAPS, RIDES, gaps, rides
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators import profiles as Q

GAP_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag"]


def _per_column(value: str, out: str, cols: list[str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {value.format(c=c)} AS {out} FROM {source}" for c in cols)


@query("distinct_counts", "A14", f"WITH {GAPS} {_per_column('count(DISTINCT {c})', 'n', GAP_COLUMNS, 'gaps')}")
def _(t: Tables):
    return Q.distinct_counts(gaps(t)).withColumnRenamed("distinct", "n")


_RIDE_COLUMNS = ["ride_id", "rideable_type", "started_at", "ended_at", "member_casual"]


@query("ride_distinct_counts", "A14", f"WITH {RIDES} {_per_column('count(DISTINCT {c})', 'n', _RIDE_COLUMNS, 'rides')}")
def _(t: Tables):
    # the rides come from a join, which is run once for all columns
    return Q.distinct_counts(rides(t), one_scan=True).withColumnRenamed("distinct", "n")


@query("distinct_with_missing", "A15", f"""
    WITH {GAPS} SELECT count(DISTINCT l_discount) + max(CASE WHEN l_discount IS NULL THEN 1 ELSE 0 END) AS n_distinct
    FROM gaps""")
def _(t: Tables):
    return Q.n_distinct(gaps(t), "l_discount")


@query("duplicate_rows", "A16", f"""
    WITH {GAPS} SELECT sum(n - 1)::BIGINT AS duplicates
    FROM (SELECT count(*) AS n FROM gaps GROUP BY l_suppkey, l_discount, l_tax, l_returnflag)""")
def _(t: Tables):
    return Q.duplicate_count(gaps(t).select("l_suppkey", "l_discount", "l_tax", "l_returnflag"))


@query("duplicate_ids", "A16", """
    SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicates FROM lineitem""")
def _(t: Tables):
    return Q.duplicate_count(t.lineitem, ["l_orderkey"])


@query("null_counts", "A17", f"""
    WITH {GAPS} {_per_column('count_if({c} IS NULL)::BIGINT', 'nulls', GAP_COLUMNS, 'gaps')}""")
def _(t: Tables):
    return Q.null_counts(gaps(t))


@query("null_percent", "A18", f"""
    WITH {GAPS} {_per_column('round(count_if({c} IS NULL) * 100 / count(*), 6)', 'percent', GAP_COLUMNS, 'gaps')}""")
def _(t: Tables):
    return rounded(Q.null_percent(gaps(t)), 6)


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_columns", "A19", f"WITH {GAPS} " + "\nUNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
           round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM gaps""" for c in _DESCRIBED))
def _(t: Tables):
    return rounded(Q.describe(gaps(t), _DESCRIBED), 4)


_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("table_profile", "A29", "\nUNION ALL ".join(f"""
    SELECT {i}::BIGINT AS position, '{c}' AS "column", '{kind}' AS type, count({c}) AS non_null, count(*) AS rows,
           {len(_PROFILED)}::BIGINT AS columns FROM orders""" for i, (c, kind) in enumerate(_PROFILED.items())))
def _(t: Tables):
    return longs(Q.table_profile(t.orders))
