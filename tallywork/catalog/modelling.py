"""Imputation, scaling, regression, classification and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.catalog.inputs import CARS, GAPS, cars, gaps
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.operators import ml as M

_IDS = "l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber"
FEATURES = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"]


def _sums(x1: str, x2: str, y: str, source: str, alpha: str = "0") -> str:
    """CTEs solving the (ridge) normal equations of two features by hand."""
    return f"""
        moments AS (
            SELECT avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
                   var_pop({x1}) * count(*) + {alpha} AS s11, var_pop({x2}) * count(*) + {alpha} AS s22,
                   covar_pop({x1}, {x2}) * count(*) AS s12, covar_pop({x1}, {y}) * count(*) AS s1y,
                   covar_pop({x2}, {y}) * count(*) AS s2y, var_pop({y}) * count(*) AS syy
            FROM {source}),
        slopes AS (
            SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                   (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM moments)"""


def _terms(x1: str, x2: str) -> str:
    return f"""
        SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 3) AS coefficient FROM slopes
        UNION ALL SELECT '{x1}', round(b1, 3) FROM slopes
        UNION ALL SELECT '{x2}', round(b2, 3) FROM slopes"""


def held_out(ids: str, fraction: float = 0.2, seed: int = 42) -> str:
    """The SQL form of ``ml.in_test_part``."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {ids})), 1, 7))::BIGINT < {round(fraction * 16 ** 7)}"


def solve(source: str, xs: list[str], y: str, alpha: float = 0.0, where: str = "true") -> str:
    """CTEs that regress ``y`` on ``xs`` over rows of ``source``, up to ``coef(b0, b1, ...)`` and ``mids(m0, ..., my)``.

    The columns are centred and made orthogonal one after another; the coefficients follow backwards. A ridge penalty is as
    many further rows, each holding its root in one column.
    """
    n = range(len(xs))
    mids = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(xs))
    centred = ", ".join(f"{x} - m{i} AS x{i}" for i, x in enumerate(xs))
    parts = [f"mids AS MATERIALIZED (SELECT {mids}, avg({y}) AS my FROM {source} WHERE {where})"]
    further = "" if not alpha else "".join(
        " UNION ALL SELECT " + ", ".join(f"{alpha} ** 0.5" if i == j else "0" for i in n) + ", 0" for j in n)
    parts.append(f"t0 AS MATERIALIZED (SELECT {centred}, {y} - my AS y FROM {source}, mids WHERE {where}{further})")
    for j in n:
        later = [i for i in n if i > j]
        shares = "".join(f", sum(x{j} * x{i}) / nullif(sum(x{j} * x{j}), 0) AS r{j}_{i}" for i in later)
        parts.append(f"s{j} AS MATERIALIZED (SELECT sum(x{j} * y) / nullif(sum(x{j} * x{j}), 0) AS g{j}{shares} FROM t{j})")
        rest = "".join(f"x{i} - r{j}_{i} * x{j} AS x{i}, " for i in later)
        parts.append(f"t{j + 1} AS MATERIALIZED (SELECT {rest}y - g{j} * x{j} AS y FROM t{j}, s{j})")
    steps, last = [], "c" + str(len(xs))
    parts.append(f"{last} AS (SELECT * FROM " + ", ".join(f"s{j}" for j in n) + ")")
    for j in reversed(n):
        minus = "".join(f" - r{j}_{i} * b{i}" for i in n if i > j)
        steps.append(f"c{j} AS MATERIALIZED (SELECT *, g{j}{minus} AS b{j} FROM c{j + 1})")
    return ", ".join([*parts, *steps, "coef AS (SELECT * FROM c0)"])


def fitted_r2(source: str, xs: list[str], y: str, where: str = "true") -> str:
    """R2 of the solved regression over rows of ``source``."""
    guess = "my" + "".join(f" + b{i} * ({x} - m{i})" for i, x in enumerate(xs))
    return f"""SELECT round(1 - sum(pow({y} - ({guess}), 2)) / (var_pop({y}) * count(*)), 6) AS r2
        FROM {source}, coef, mids WHERE {where}"""


HOUSES = """houses AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, p_retailprice, p_size::DOUBLE AS p_size
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""
HOUSE_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
_TEST = held_out(", ".join(HOUSE_IDS), 0.2, 1)
_PRODUCTS = [f"({a} * {b})" for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


def house_rows(t: Tables):
    joined = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                         *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return M.stage_features(rows)


def _score(predicted):
    return rounded(M.r2_score(predicted, "l_extendedprice"), 6)


def document_rows(t: Tables):
    docs = t.documents.select("doc_id", "n_chars", "lang", "source")
    joined = t.labels.join(docs, "doc_id")
    rows = joined.select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"),
        *[(F.col("lang") == lang).cast("double").alias(f"is_{lang}") for lang in ("en", "fr", "de")],
        F.substring("source", 4, 3).cast("double").alias("source_no"))
    return M.stage_features(rows)


DOC_FEATURES = ["n_chars", "is_en", "is_fr", "is_de", "source_no"]


@query("impute_mean", "M1 H13", f"""
    WITH {GAPS} SELECT {_IDS}, round(coalesce(l_discount, (SELECT avg(l_discount) FROM gaps)), 6) AS l_discount,
           round(coalesce(l_tax, (SELECT avg(l_tax) FROM gaps)), 6) AS l_tax FROM gaps""")
def _(t: Tables):
    filled = M.impute_mean(gaps(t), ["l_discount", "l_tax"])
    return longs(rounded(filled.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"), 6))


@query("standardize", "M2", """
    SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
                             / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice
    FROM orders""")
def _(t: Tables):
    return rounded(M.standardize(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 6)


@query("standardize_on_train_part", "M2", """
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, s WHERE o_orderstatus = 'P'""")
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    train, test = orders.filter("o_orderstatus <> 'P'"), orders.filter("o_orderstatus = 'P'")
    return rounded(M.standardize(test, ["o_totalprice"], fit_on=train).drop("o_orderstatus"), 6)


@query("polynomial_features", "M3", """
    SELECT c_custkey, round(c_acctbal, 4) AS x, round(c_acctbal * c_acctbal, 2) AS xx, c_nationkey::DOUBLE AS y,
           round(c_acctbal * c_nationkey, 4) AS xy, (c_nationkey * c_nationkey)::DOUBLE AS yy FROM customer""")
def _(t: Tables):
    expanded = M.polynomial_features(t.customer, ["c_acctbal", "c_nationkey"])
    terms = [F.round(F.col("poly")[i], 2 if name == "xx" else 4).alias(name)
             for i, name in enumerate(("x", "xx", "y", "xy", "yy"))]
    return expanded.select("c_custkey", *terms)


@query("train_test_split", "M4", f"""
    SELECT o_orderkey, CASE WHEN {held_out('o_orderkey', 0.2, 1)} THEN 'test' ELSE 'train' END AS part FROM orders""")
def _(t: Tables):
    train, test = M.train_test_split(t.orders, "o_orderkey", 0.2, seed=1)
    return train.select("o_orderkey", F.lit("train").alias("part")).union(test.select("o_orderkey", F.lit("test").alias("part")))


@query("linear_fit", "M5", f"""
    WITH {_sums('l_quantity', 'l_discount', 'l_extendedprice', 'lineitem')} {_terms('l_quantity', 'l_discount')}""")
def _(t: Tables):
    features = ["l_quantity", "l_discount"]
    model = M.linear_fit(t.lineitem, features, "l_extendedprice")
    return rounded(M.coefficients(model, features, t.lineitem), 3)


@query("linear_fit_many_features", "M5 M7", f"""
    WITH {HOUSES}, {solve('houses', FEATURES, 'l_extendedprice')} {fitted_r2('houses', FEATURES, 'l_extendedprice')}""")
def _(t: Tables):
    rows = house_rows(t)
    model = M.linear_fit(rows, FEATURES, "l_extendedprice")
    return _score(M.predict(model, rows, FEATURES))


@query("ridge_fit", "M6", f"""
    WITH {_sums('l_quantity', 'l_tax', 'l_extendedprice', 'lineitem', '10.0')} {_terms('l_quantity', 'l_tax')}""")
def _(t: Tables):
    features = ["l_quantity", "l_tax"]
    model = M.ridge_fit(t.lineitem, features, "l_extendedprice", alpha=10.0)
    return rounded(M.coefficients(model, features, t.lineitem), 3)


@query("ridge_on_held_out_rows", "M4 M6 M7", f"""
    WITH {HOUSES}, {solve('houses', FEATURES, 'l_extendedprice', 0.1, f'NOT {_TEST}')}
    {fitted_r2('houses', FEATURES, 'l_extendedprice', _TEST)}""")
def _(t: Tables):
    train, test = M.train_test_split(house_rows(t), ["l_orderkey", "l_linenumber", "l_partkey"], 0.2, seed=1)
    model = M.ridge_fit(train, FEATURES, "l_extendedprice", alpha=0.1)
    return _score(M.predict(model, test, FEATURES))


@query("polynomial_ridge_on_held_out_rows", "M3 M6 M8", f"""
    WITH {HOUSES}, {solve('houses', [*FEATURES, *_PRODUCTS], 'l_extendedprice', 0.1, f'NOT {_TEST}')}
    {fitted_r2('houses', [*FEATURES, *_PRODUCTS], 'l_extendedprice', _TEST)}""")
def _(t: Tables):
    train, test = M.train_test_split(house_rows(t), ["l_orderkey", "l_linenumber", "l_partkey"], 0.2, seed=1)
    pipeline = M.regression_pipeline(FEATURES, "l_extendedprice", degree=2, scale=False, ridge_on=train)
    return _score(M.predict(pipeline.fit(train), test))


@query("r2_score", "M7", """
    SELECT round(1 - sum(pow(l_extendedprice - 2100 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
    FROM lineitem""")
def _(t: Tables):
    return rounded(M.r2_score(t.lineitem.withColumn("prediction", 2100 * F.col("l_quantity")), "l_extendedprice"), 6)


@query("scale_expand_regress", "M8 M7", f"""
    WITH {CARS}, xs AS (SELECT "Price" AS x1, "Price" * "Price" AS x2, "Advertising_Expenditure" AS y FROM cars),
    {_sums('x1', 'x2', 'y', 'xs')}
    SELECT round((b1 * s1y + b2 * s2y) / syy, 6) AS r2 FROM slopes""")
def _(t: Tables):
    df = M.stage_features(cars(t).select("Price", "Advertising_Expenditure"))
    model = M.regression_pipeline(["Price"], "Advertising_Expenditure", degree=2).fit(df)
    return rounded(M.r2_score(M.predict(model, df), "Advertising_Expenditure"), 6)


@query("forest_report", "M9 M10")
def _(t: Tables):
    train, test = M.train_test_split(document_rows(t), "doc_id", 0.2)
    model = M.random_forest_fit(train, DOC_FEATURES, "quality", trees=100, max_depth=5)
    return M.classification_report(M.predict(model, test, DOC_FEATURES), "quality")


@query("forest_report_facts", "M9 M10", f"""
    WITH part AS (SELECT quality::DOUBLE::VARCHAR AS cls FROM labels JOIN documents USING (doc_id) WHERE {held_out('doc_id')})
    SELECT cls AS row, count(*) AS support, true AS sound FROM part GROUP BY cls
    UNION ALL SELECT name, (SELECT count(*) FROM part), true FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) n(name)""")
def _(t: Tables):
    """What any right forest's report says: the rows, their support, scores from 0 to 1, accuracy no less than the majority's share."""
    train, test = M.train_test_split(document_rows(t), "doc_id", 0.2)
    model = M.random_forest_fit(train, DOC_FEATURES, "quality", trees=100, max_depth=5)
    report = M.classification_report(M.predict(model, test, DOC_FEATURES), "quality")
    majority = report.filter("row NOT LIKE '% avg' AND row <> 'accuracy'").agg(F.max("support")).scalar()
    fits = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    better = (F.col("row") != "accuracy") | (F.col("precision") >= majority / F.col("support") - 1e-9)
    return report.select("row", "support", (fits & better).alias("sound"))


@query("feature_importance_facts", "M11", """
    SELECT 5::BIGINT AS features, 1.0::DOUBLE AS total, true AS in_order, count(*) > 0 AS any_rows FROM labels""")
def _(t: Tables):
    """What any right forest's importances are: one a feature, none negative, descending, 1 in total."""
    rows = document_rows(t)
    model = M.importance_forest_fit(rows, DOC_FEATURES, "quality", trees=100, max_depth=5)
    listed = M.feature_importance(model, DOC_FEATURES, rows).withColumn("place", F.monotonically_increasing_id())
    after = F.lead("importance").over(Window.orderBy("place"))  # a row a feature
    return listed.withColumn("next", F.coalesce(after, F.lit(0.0))).agg(
        F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.bool_and(F.col("importance") >= F.col("next")).alias("in_order"), (F.count(F.lit(1)) > 0).alias("any_rows"))


@query("feature_importance", "M11")
def _(t: Tables):
    rows = document_rows(t)
    model = M.importance_forest_fit(rows, DOC_FEATURES, "quality", trees=100, max_depth=5)
    return M.feature_importance(model, DOC_FEATURES, rows)


@query("classification_report", "M10", """
    WITH p AS (SELECT quality::VARCHAR AS a, CASE WHEN n_chars > 1000 THEN '1' WHEN n_chars > 200 THEN '0' ELSE '2' END AS b
               FROM labels JOIN documents USING (doc_id)),
    cls AS (SELECT a AS c FROM p UNION SELECT b FROM p),
    s AS (SELECT c, count_if(a = c) AS support, count_if(b = c) AS claimed, count_if(a = c AND b = c) AS hit
          FROM p CROSS JOIN cls GROUP BY c),
    m AS (SELECT c, support, hit, coalesce(hit / nullif(claimed, 0), 0) AS precision,
                 coalesce(hit / nullif(support, 0), 0) AS recall,
                 coalesce(2 * hit / nullif(claimed + support, 0), 0) AS f1 FROM s)
    SELECT c AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           support::BIGINT AS support FROM m
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
                     round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM m
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                     sum(support)::BIGINT FROM m
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                     round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                     sum(support)::BIGINT FROM m""")
def _(t: Tables):
    df = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    guess = F.when(F.col("n_chars") > 1000, 1).when(F.col("n_chars") > 200, 0).otherwise(2)
    return rounded(M.classification_report(df.withColumn("prediction", guess), "quality"), 6)
