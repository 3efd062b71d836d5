"""Imputation, scaling, regression and classification on Spark ML, and their scores in SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.session import write_scratch

FEATURES = "features"


def impute_mean(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, at_once: bool = False) -> DataFrame:
    """Fill missing values with the column mean, taken from ``fit_on`` (for example the train part).

    ``at_once`` works the means out in a job of its own, for rows that several jobs will read: else each finds them anew.
    """
    found = (fit_on if fit_on is not None else df).agg(
        F.struct(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in cols]))
    if at_once:
        row = found.first()[0]
        means = {c: F.lit(row[c]) for c in cols}
    else:
        means = found.scalar()
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), means[c]) for c in cols}
    return df.withColumns(filled)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = (fit_on if fit_on is not None else df).agg(F.struct(*[
        f(c).alias(f"{name}_{c}") for c in cols for name, f in (("m", F.avg), ("s", F.stddev_pop))
    ])).scalar()
    scaled = {}
    for c in cols:
        spread = stats[f"s_{c}"]
        scaled[c] = (F.col(c) - stats[f"m_{c}"]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return df.withColumns(scaled)


def assemble(df: DataFrame, features: Sequence[str], out: str = FEATURES) -> DataFrame:
    """The feature columns as one vector; a row with a missing feature is an error."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def polynomial_features(df: DataFrame, features: Sequence[str], degree: int = 2, out: str = "poly") -> DataFrame:
    """All products of the features up to ``degree``, without a constant, as an array column."""
    expansion = PolynomialExpansion(degree=degree, inputCol="__vector", outputCol="__expanded")
    expanded = expansion.transform(assemble(df, features, "__vector"))
    return expanded.withColumn(out, vector_to_array("__expanded")).drop("__vector", "__expanded")


def stage_features(df: DataFrame, label: str = "features") -> DataFrame:
    """Write the prepared rows once, in even pieces: fitting and scoring pass over them repeatedly."""
    return write_scratch(df.hint("rebalance"), label)


def in_test_part(row_id: Sequence[str], fraction: float, seed: int) -> Column:
    """Whether a row belongs to the test part: decided by its id alone, whatever the partitioning.

    The first seven hexadecimal digits of the MD5 of "seed|id|..." say so, which any other engine can work out too.
    Missing ids are left out of the text.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_id]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") < F.lit(round(fraction * 16 ** 7))


def train_test_split(
    df: DataFrame, row_id: str | Sequence[str], fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint (train, test) parts, ``fraction`` of the rows (in expectation) in the latter."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    test = in_test_part(ids, fraction, seed)
    return df.filter(~test), df.filter(test)


def linear_fit(df: DataFrame, features: Sequence[str], label: str) -> LinearRegressionModel:
    """Ordinary least squares by the normal equations: one distributed pass."""
    solver = LinearRegression(featuresCol=FEATURES, labelCol=label, solver="normal", regParam=0.0)
    return solver.fit(assemble(df.select(*features, label), features))


def ridge_fit(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.1) -> LinearRegressionModel:
    """Least squares plus ``alpha`` times the squared norm of the coefficients, intercept free."""
    return _ridge(df, label, alpha).fit(assemble(df.select(*features, label), features))


def _ridge(df: DataFrame, label: str, alpha: float) -> LinearRegression:
    # Spark divides the squared error by n and scales the penalty by the label's deviation
    row = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(
        featuresCol=FEATURES, labelCol=label, solver="normal", elasticNetParam=0.0,
        standardization=False, regParam=alpha / row["n"] * row["sd"],
    )


def regression_pipeline(
    features: Sequence[str], label: str, degree: int = 2, scale: bool = True,
    ridge_on: DataFrame | None = None, alpha: float = 0.1,
) -> Pipeline:
    """Scale, expand, regress; ridge regression if ``ridge_on`` names the rows it will be fitted on."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="__vector")]
    last = "__vector"
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=last, outputCol="__scaled"))
        last = "__scaled"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol=last, outputCol="__expanded"))
        last = "__expanded"
    if ridge_on is None:
        solver = LinearRegression(labelCol=label, solver="normal", regParam=0.0)
    else:
        solver = _ridge(ridge_on, label, alpha)
    return Pipeline(stages=[*stages, solver.setFeaturesCol(last)])


def predict(model, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the column ``prediction``; ``features`` unless the model is a pipeline."""
    if isinstance(model, PipelineModel):
        helpers = ["__vector", "__scaled", "__expanded"]
        return model.transform(df).drop(*helpers)
    return model.transform(assemble(df, features)).drop(FEATURES, "rawPrediction", "probability")


def coefficients(model: LinearRegressionModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(term, coefficient) rows, the intercept among them; ``df`` only lends its session."""
    rows = [("intercept", float(model.intercept))]
    rows += [(name, float(c)) for name, c in zip(features, model.coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def r2_score(df: DataFrame, label: str, prediction: str = "prediction", out: str = "r2") -> DataFrame:
    """1 - squared error / squared deviation from the mean, in one pass."""
    error = F.sum(F.pow(F.col(label) - F.col(prediction), 2))
    spread = F.var_pop(label) * F.count(label)
    return df.agg((1 - F.try_divide(error, spread)).alias(out))


def fitted_r2(model: LinearRegressionModel | PipelineModel, df: DataFrame, out: str = "r2") -> DataFrame:
    """R2 on the rows that a linear model was fitted on, which the fit has counted already; ``df`` only lends its session."""
    r2 = (model.stages[-1] if isinstance(model, PipelineModel) else model).summary.r2
    return df.sparkSession.createDataFrame([(r2 if math.isfinite(r2) else None,)], f"{out} double")


def random_forest_fit(
    df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42, *, max_depth: int
) -> RandomForestClassificationModel:
    """A forest of ``trees`` trees on binned features, grown level by level over all executors.

    ``max_depth`` bounds the cost: each level is one more pass over the rows, and a tree of depth d has up to 2 ** d leaves.
    Spark allows up to 30; the caller has to choose.
    """
    forest = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth)
    return forest.fit(assemble(df.select(*features, label), features))


def importance_forest_fit(
    df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42, *, max_depth: int
) -> RandomForestRegressionModel:
    """A forest for the importances of two classes, 0 and 1, whose trees stay whole.

    Spark's classifier joins leaves that predict the same class, so that where one class prevails a whole tree becomes
    one leaf and none of its splits count. Regression on the label has the same splits to choose from, as the variance of 0
    and 1 is half their Gini impurity, and joins only leaves of the same mean. Other labels, or missing ones, are an error.
    """
    wrong = df.filter(F.col(label).isNull() | ~F.col(label).isin(0, 1)).select(label).first()
    if wrong is not None:
        raise ValueError(f"label {wrong[0]} is neither 0 nor 1")
    forest = RandomForestRegressor(
        featuresCol=FEATURES, labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth, featureSubsetStrategy="sqrt")
    return forest.fit(assemble(df.select(*features, label), features))


def feature_importance(
    model: RandomForestClassificationModel | RandomForestRegressionModel, features: Sequence[str], df: DataFrame
) -> DataFrame:
    """(feature, importance), most important first; of two classes, by a model of ``importance_forest_fit``."""
    rows = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def confusion_counts(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(row, precision, recall, f1, support) per class, then accuracy, macro and weighted averages.

    Empty denominators give 0. The rows are reduced to a confusion table in one shuffle; all else
    is arithmetic on it.
    """
    counts = confusion_counts(
        df.select(F.col(label).cast("string").alias("a"), F.col(prediction).cast("string").alias("b")),
        "a", "b")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
    )
    per_class = counts.select(F.inline(sides)).groupBy("cls").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("support", "claimed", "hit")])

    def over(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = per_class.select(
        "cls", "support", "hit",
        over(F.col("hit"), F.col("claimed")).alias("precision"),
        over(F.col("hit"), F.col("support")).alias("recall"),
        over(2 * F.col("hit"), F.col("claimed") + F.col("support")).alias("f1"),
    )
    total = F.sum("support")
    macro = F.struct(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                     total.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("row"),
                        *[over(F.sum(F.col(c) * F.col("support")), total).alias(c)
                          for c in ("precision", "recall", "f1")],
                        total.alias("support"))
    right = over(F.sum("hit"), total)
    accuracy = F.struct(F.lit("accuracy").alias("row"), right.alias("precision"), right.alias("recall"),
                        right.alias("f1"), total.alias("support"))
    summary = scored.agg(F.array(accuracy, macro, weighted).alias("rows")).select(F.inline("rows"))
    classes = scored.select(F.col("cls").alias("row"), "precision", "recall", "f1", "support")
    return classes.union(summary).withColumn("support", F.col("support").cast("long"))
