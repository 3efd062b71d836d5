"""Personality: survey answers to a forest that tells two labels apart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import ml as M
from tallywork.operators.aggregates import value_counts
from tallywork.operators.columns import recode
from tallywork.operators.profiles import null_counts
from tallywork.operators.stats import correlation_matrix

# fixed values: the survey's columns and codes
MEASURES = ("Time_spent_Alone", "Social_event_attendance", "Going_outside", "Friends_circle_size", "Post_frequency")
ANSWERS = ("Stage_fear", "Drained_after_socializing")
YES_NO = {"Yes": 1, "No": 0}
LABELS = {"Introvert": 1, "Extrovert": 0}


def prepare_answers(survey: DataFrame, key: str) -> DataFrame:
    """Words recoded to numbers (once; unknown ones are missing), missing measures and answers filled with the means."""
    coded = survey.select(key, *MEASURES, *ANSWERS, "Personality")
    for column in ANSWERS:
        coded = recode(coded, column, YES_NO)
    coded = recode(coded, "Personality", LABELS).filter(F.col("Personality").isNotNull())
    return M.impute_mean(coded.withColumn("Personality", F.col("Personality").cast("double")), [*MEASURES, *ANSWERS])


def personality_report(
    survey: DataFrame, key: str, trees: int = 100, max_depth: int = 8, test_share: float = 0.2, seed: int = 42,
    only: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The scaled parts, the forest's report on rows held out, and the importances.

    Scaling takes mean and deviation from the train part alone. ``max_depth`` bounds the cost of the trees.
    ``only`` names the tables wanted; the forests, one for the report and one for the importances, are grown if asked for.
    """
    features: Sequence[str] = [*MEASURES, *ANSWERS]
    rows = M.stage_features(prepare_answers(survey, key), "answers")
    train, test = M.train_test_split(rows, key, test_share, seed)
    scaled_train = M.stage_features(M.standardize(train, features, fit_on=train), "train")
    scaled_test = M.standardize(test, features, fit_on=train)

    @cache
    def model():
        return M.random_forest_fit(scaled_train, features, "Personality", trees, seed, max_depth=max_depth)

    tables = {
        "missing": lambda: null_counts(survey.select(*MEASURES, *ANSWERS, "Personality")),
        "labels": lambda: value_counts(survey, "Personality"),
        "correlations": lambda: correlation_matrix(rows, [*features, "Personality"]),
        "train": lambda: scaled_train,
        "test": lambda: scaled_test,
        "report": lambda: M.classification_report(M.predict(model(), scaled_test, features), "Personality"),
        "importance": lambda: M.feature_importance(
            M.importance_forest_fit(scaled_train, features, "Personality", trees, seed, max_depth=max_depth), features, rows),
    }
    return {name: table() for name, table in tables.items() if only is None or name in only}
