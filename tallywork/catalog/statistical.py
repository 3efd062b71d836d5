"""Correlation, boxplots, regression lines, bootstrap bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.inputs import CARS, GAPS, cars, gaps
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators import quantiles as Q
from tallywork.operators import stats as S

_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

BOX = """
    quart AS (SELECT {g}, count({v}) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
                     quantile_cont({v}, 0.75) AS q3 FROM {t} WHERE {g} IS NOT NULL GROUP BY {g}),
    fenced AS (SELECT {t}.*, n, q1, median, q3, {v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1) AS beyond
               FROM {t} JOIN quart USING ({g}))"""


@query("correlation_matrix", "A22", f"WITH {GAPS} " + "\nUNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM gaps"
    for x in _CORRELATED for y in _CORRELATED))
def _(t: Tables):
    return rounded(S.correlation_matrix(gaps(t), _CORRELATED), 6)


_DIMENSIONS = 64


@query("embedding_correlations", "A22", f"""
    WITH cells AS (SELECT vec_id, d, CASE WHEN (vec_id + d) % 7 <> 0 THEN embedding[d + 1] END AS v
                   FROM embeddings, range({_DIMENSIONS}) AS r(d))
    SELECT 'd' || a.d AS x, 'd' || b.d AS y, round(corr(a.v, b.v), 6) AS r
    FROM cells a JOIN cells b USING (vec_id) GROUP BY a.d, b.d""")
def _(t: Tables):
    # a seventh of the cells is missing, in other rows for each column
    cells = [F.when((F.col("vec_id") + d) % 7 != 0, F.col("embedding")[d]).alias(f"d{d}") for d in range(_DIMENSIONS)]
    return rounded(S.wide_correlations(t.embeddings.select(*cells), [f"d{d}" for d in range(_DIMENSIONS)]), 6)


@query("pair_correlation", "A23", f"""
    WITH {CARS} SELECT round(corr("Automobile_Sales", "Advertising_Expenditure"), 6) AS r FROM cars""")
def _(t: Tables):
    return rounded(S.pair_correlation(cars(t), "Automobile_Sales", "Advertising_Expenditure"), 6)


@query("box_summary", "A24", f"""
    WITH {BOX.format(g="event_type", v="value", t="events")}
    SELECT event_type, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
           round(any_value(q3), 4) AS q3, min(CASE WHEN NOT beyond THEN value END) AS low_whisker,
           max(CASE WHEN NOT beyond THEN value END) AS high_whisker, count_if(beyond)::BIGINT AS outliers
    FROM fenced GROUP BY event_type""")
def _(t: Tables):
    return rounded(S.box_summary(t.events, "event_type", "value"), 4)


@query("outlier_rows", "A25", f"""
    WITH {BOX.format(g="event_type", v="value", t="events")}
    SELECT event_id, event_type, value FROM fenced WHERE beyond""")
def _(t: Tables):
    return S.outliers(t.events.select("event_id", "event_type", "value"), "event_type", "value")


@query("group_quantiles", "A19 A24", """
    SELECT l_suppkey, prob, round(quantile, 4) AS quantile FROM (
        SELECT l_suppkey, unnest([0.05, 0.5, 0.95])::DOUBLE AS prob,
               unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])) AS quantile
        FROM lineitem GROUP BY l_suppkey)""")
def _(t: Tables):
    return rounded(Q.quantiles(t.lineitem, "l_extendedprice", [0.05, 0.5, 0.95], ["l_suppkey"]), 4, "quantile")


@query("approximate_quantiles_in_rank", "A19", """
    SELECT DISTINCT l_returnflag, prob::DOUBLE AS prob, true AS close FROM lineitem, (VALUES (0.25), (0.5), (0.75)) p(prob)""")
def _(t: Tables):
    """The sketch keeps its promise: the rank of each value lies within a ten thousandth of the rank asked for, and one row."""
    found = Q.quantiles(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.75], ["l_returnflag"], approx=True)
    counted = t.lineitem.select("l_returnflag", "l_extendedprice").join(found, "l_returnflag").groupBy(
        "l_returnflag", "prob").agg(
        F.count_if(F.col("l_extendedprice") < F.col("quantile")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("quantile")).alias("up_to"), F.count(F.lit(1)).alias("n"))
    slack = F.col("n") / 10_000 + 1
    return counted.select("l_returnflag", "prob", (
        (F.col("below") <= F.col("prob") * F.col("n") + slack) & (F.col("up_to") >= F.col("prob") * F.col("n") - slack)).alias("close"))


@query("approximate_quantiles", "A19")
def _(t: Tables):
    return Q.quantiles(t.lineitem, "l_extendedprice", [0.25, 0.5, 0.75], ["l_returnflag"], approx=True)


@query("regression_line", "A26 M5", f"""
    WITH {CARS} SELECT round(regr_slope("Advertising_Expenditure", "Automobile_Sales"), 4) AS slope,
           round(regr_intercept("Advertising_Expenditure", "Automobile_Sales"), 4) AS intercept,
           round(regr_r2("Advertising_Expenditure", "Automobile_Sales"), 6) AS r2 FROM cars""")
def _(t: Tables):
    line = S.regression_line(cars(t), "Automobile_Sales", "Advertising_Expenditure")
    return rounded(rounded(line, 4, "slope", "intercept"), 6, "r2")


@query("regression_line_by_key", "A26", """
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag""")
def _(t: Tables):
    line = S.regression_line(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(line, 4, "slope", "intercept"), 6, "r2")


@query("trend_means", "A27", f"""
    WITH {CARS} SELECT "Year", "Vehicle_Type", "Recession"::BIGINT AS "Recession", round(avg("Automobile_Sales"), 4) AS mean,
           true AS inside_band, true AS narrow FROM cars GROUP BY ALL""")
def _(t: Tables):
    keys = ["Year", "Vehicle_Type", "Recession"]
    df = cars(t)
    band = S.mean_with_ci(df, keys, "Automobile_Sales", n_boot=400)
    # the band has no exact twin in SQL: the mean must lie in it, and its width must fit the standard error
    error = df.groupBy(*keys).agg((F.stddev_samp("Automobile_Sales") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    width = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("se"))
    checked = band.join(error, keys).select(
        *keys, F.round("mean", 4).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside_band"),
        width.between(0.5, 1.5).alias("narrow"))
    return longs(checked)


@query("bootstrap_band_fits", "A27", """
    SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, true AS inside, true AS width FROM lineitem GROUP BY ALL""")
def _(t: Tables):
    """The exact mean, and a band around it as wide as the standard error says, within a tenth."""
    keys = ["l_returnflag", "l_linestatus"]
    band = S.mean_with_ci(t.lineitem, keys, "l_quantity")
    error = t.lineitem.groupBy(*keys).agg((F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    width = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("se"))
    return band.join(error, keys).select(
        *keys, F.round("mean", 6).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"),
        width.between(0.85, 1.15).alias("width"))


@query("bootstrap_band", "A27")
def _(t: Tables):
    return S.mean_with_ci(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")


@query("value_histogram", "D6", """
    SELECT event_type, floor(value / 25)::BIGINT AS bin, floor(value / 25) * 25 AS bin_start, count(*) AS count
    FROM events GROUP BY ALL""")
def _(t: Tables):
    return S.histogram(t.events, "value", 25.0, ["event_type"])
