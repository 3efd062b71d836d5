import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallywork.operators import ml as M
from tallywork.plans.house import house_report
from tallywork.plans.personality import MEASURES, personality_report


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = np.c_[rng.uniform(0, 10, n), rng.normal(50, 20, n), rng.integers(0, 3, n)]
    y = 7 + x @ [3.0, -0.5, 11.0] + rng.normal(0, 4, n)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id int, a double, b double, c double, price double")
    return df.cache(), x, y


def solve(x, y, alpha=0.0):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


def test_impute_mean(spark):
    df = spark.createDataFrame([(1.0, None), (None, 4.0), (float("nan"), 6.0), (3.0, 8.0)], "x double, y double")
    assert rows(M.impute_mean(df, ["x", "y"])) == [(1.0, 6.0), (2.0, 4.0), (2.0, 6.0), (3.0, 8.0)]
    train = spark.createDataFrame([(10.0, 0.0)], "x double, y double")
    assert rows(M.impute_mean(df, ["x"], fit_on=train).select("x")) == [(1.0,), (10.0,), (10.0,), (3.0,)]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    assert rows(M.standardize(df, ["x", "c"])) == [(None, 0.0), (-1.0, 0.0), (1.0, 0.0)]
    assert rows(M.standardize(spark.createDataFrame([(7.0,)], "x double"), ["x"], fit_on=df)) == [(5.0,)]


def test_polynomial_features(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert sorted(rows(M.polynomial_features(df, ["a", "b"]).select("poly"))[0][0]) == [2.0, 3.0, 4.0, 6.0, 9.0]
    wide = df.select(*[F.lit(float(i)).alias(f"f{i}") for i in range(11)])
    assert len(rows(M.polynomial_features(wide, wide.columns).select("poly"))[0][0]) == 77


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(5000)
    train, test = M.train_test_split(df, "id", 0.2, seed=1)
    again = M.train_test_split(df.repartition(13), ["id"], 0.2, seed=1)[1]
    assert set(rows(test)) == set(rows(again)) and not set(rows(train)) & set(rows(test))
    assert train.count() + test.count() == 5000 and 900 < test.count() < 1100
    assert set(rows(M.train_test_split(df, "id", 0.2, seed=2)[1])) != set(rows(test))


def test_linear_and_ridge_match_the_closed_form(spark, houses):
    df, x, y = houses
    features = ["a", "b", "c"]
    for alpha in (0.0, 0.1, 500.0):
        model = M.linear_fit(df, features, "price") if alpha == 0 else M.ridge_fit(df, features, "price", alpha)
        w, b = solve(x, y, alpha)
        got = {r["term"]: r["coefficient"] for r in M.coefficients(model, features, df).collect()}
        assert np.allclose([got[f] for f in features], w, rtol=1e-6) and abs(got["intercept"] - b) < 1e-5
        r2 = rows(M.r2_score(M.predict(model, df, features), "price"))[0][0]
        fitted = x @ w + b
        assert abs(r2 - (1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6


def test_pipelines(spark, houses):
    df, x, y = houses
    model = M.regression_pipeline(["a", "b", "c"], "price").fit(df)
    scored = M.predict(model, df)
    assert scored.columns == [*df.columns, "prediction"]
    expanded = np.c_[x, x ** 2, x[:, :1] * x[:, 1:2], x[:, :1] * x[:, 2:], x[:, 1:2] * x[:, 2:]]
    w, b = solve(expanded, y)
    want = 1 - ((y - expanded @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(rows(M.r2_score(scored, "price"))[0][0] - want) < 1e-6
    ridge = M.regression_pipeline(["a", "b", "c"], "price", scale=False, ridge_on=df, alpha=0.1).fit(df)
    w, b = solve(expanded, y, 0.1)
    want = 1 - ((y - expanded @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(rows(M.r2_score(M.predict(ridge, df), "price"))[0][0] - want) < 1e-6


def test_forest(spark):
    rng = np.random.default_rng(2)
    n = 600
    signal, noise = rng.normal(size=n), rng.normal(size=n)
    label = (signal + rng.normal(0, 0.3, n) > 0).astype(float)
    df = spark.createDataFrame([(i, float(s), float(z), float(v)) for i, (s, z, v) in enumerate(zip(signal, noise, label))],
                               "id int, signal double, noise double, label double")
    train, test = M.train_test_split(df, "id", 0.2)
    model = M.random_forest_fit(train, ["signal", "noise"], "label", trees=30, max_depth=4)
    report = {r["row"]: r for r in M.classification_report(M.predict(model, test, ["signal", "noise"]), "label").collect()}
    assert report["accuracy"]["f1"] > 0.8 and report["accuracy"]["support"] == test.count()
    importance = rows(M.feature_importance(model, ["signal", "noise"], df), True)
    assert importance[0][0] == "signal" and abs(sum(v for _, v in importance) - 1) < 1e-9


def test_fitted_r2_is_that_of_the_predictions(houses):
    df, names = houses[0], ["a", "b", "c"]
    for model, by in ((M.linear_fit(df, names, "price"), names), (M.regression_pipeline(names, "price").fit(df), None)):
        want = rows(M.r2_score(M.predict(model, df, by), "price"))[0][0]
        assert abs(rows(M.fitted_r2(model, df))[0][0] - want) < 1e-9
    flat = df.withColumn("price", F.lit(5.0))
    assert rows(M.fitted_r2(M.linear_fit(flat, names, "price"), flat)) == [(None,)]


def test_house_report_works_its_rows_out_once(spark):
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        worked_out.add(1)
        return x

    rng = np.random.default_rng(5)
    data = [(str(i), *map(float, v)) for i, v in enumerate(rng.normal(size=(500, 3)))]
    source = spark.createDataFrame(data, "id string, price double, x double, y double")
    source = source.withColumn("x", F.when(F.col("id") != "7", counted("x")))
    report = house_report(source, ["x", "y"], single="x", only=["r2_all", "r2_expanded"])
    all_, expanded = (rows(report[name])[0][0] for name in ("r2_all", "r2_expanded"))
    assert 0 <= all_ <= expanded < 1 and worked_out.value == 500
    held_out = house_report(source, ["x", "y"], single="x", only=["prepared", "r2_ridge_held_out"])
    assert held_out["prepared"].columns == ["id", "price", "x", "y"]
    assert held_out["prepared"].filter("x IS NULL").count() == 0 and rows(held_out["r2_ridge_held_out"])[0][0] < 1


def test_importances_where_one_class_prevails(spark):
    """Nine of ten rows are of class 1 on either side of every split, so a forest of the classes has no split left to count."""
    df = spark.range(4000).select("id", (F.col("id") % 2).cast("double").alias("signal"), (F.col("id") % 7).cast("double").alias("noise"))
    df = df.withColumn("label", F.when(F.pmod(F.hash("id"), F.when(F.col("signal") == 1, 20).otherwise(6)) == 0, 0.0).otherwise(1.0))
    names = ["signal", "noise"]
    of_classes = M.random_forest_fit(df, names, "label", trees=20, max_depth=3)
    assert sum(v for _, v in rows(M.feature_importance(of_classes, names, df))) == 0
    listed = rows(M.feature_importance(M.importance_forest_fit(df, names, "label", trees=20, max_depth=3), names, df), True)
    assert [name for name, _ in listed] == names and abs(sum(v for _, v in listed) - 1) < 1e-9
    with pytest.raises(ValueError, match="neither"):
        M.importance_forest_fit(df.withColumn("label", F.lit(2)), names, "label", max_depth=3)


def test_personality_importance_where_one_class_prevails(spark):
    often = F.pmod(F.hash("id"), F.when(F.col("id") % 2 == 1, 20).otherwise(6)) > 0
    survey = spark.range(2000).select(
        "id", *[F.lit(1.0).alias(c) for c in MEASURES], F.when(F.col("id") % 2 == 1, "Yes").otherwise("No").alias("Stage_fear"),
        F.lit("No").alias("Drained_after_socializing"), F.when(often, "Introvert").otherwise("Extrovert").alias("Personality"))
    listed = rows(personality_report(survey, "id", trees=10, max_depth=3, only=["importance"])["importance"], True)
    assert listed[0][0] == "Stage_fear" and abs(sum(v for _, v in listed) - 1) < 1e-9


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    got = {r["row"]: tuple(round(v, 4) for v in r[1:]) for r in M.classification_report(df, "label").collect()}
    assert got["0"] == (0.6667, 1.0, 0.8, 2) and got["1"] == (0.0, 0.0, 0.0, 1) and got["2"] == (1.0, 1.0, 1.0, 1)
    assert got["accuracy"] == (0.75, 0.75, 0.75, 4)
    assert got["macro avg"] == (0.5556, 0.6667, 0.6, 4) and got["weighted avg"] == (0.5833, 0.75, 0.65, 4)
