"""House prices: summary, regressions on one and on many features, and their scores on rows held out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import ml as M
from tallywork.operators.aggregates import value_counts
from tallywork.operators.profiles import describe
from tallywork.operators.stats import pair_correlation

# fixed values: the features of the price models
HOUSE_FEATURES = (
    "floors", "waterfront", "lat", "bedrooms", "sqft_basement", "view", "bathrooms", "sqft_living15", "sqft_above", "grade",
    "sqft_living",
)


# the tables that tell houses apart by their key
KEYED = frozenset({"prepared", "r2_ridge_held_out", "r2_ridge_expanded_held_out"})


def prepare_houses(houses: DataFrame, features: Sequence[str] = HOUSE_FEATURES, key: str | None = "id") -> DataFrame:
    """(key, price, features as doubles), missing features filled with their means; written once for all fits.

    The rows are written as they come, so that ``houses`` is worked out once, and filled when read. Without a key
    they are written without one.
    """
    kept = [key] if key is not None else []
    rows = M.stage_features(houses.select(*kept, F.col("price").cast("double").alias("price"), *features), "houses")
    return M.impute_mean(rows, features, at_once=True)


def house_report(
    houses: DataFrame, features: Sequence[str] = HOUSE_FEATURES, key: str = "id", single: str = "sqft_living",
    alpha: float = 0.1, test_share: float = 0.2, seed: int = 1, only: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Summary tables of ``houses`` and five values of R2.

    On all rows: one feature, all features, and all features scaled and expanded to squares and products. On rows held out (a
    share decided by the key, see ``ml.in_test_part``): ridge regression on the features, and on their expansion. The
    means that fill gaps are those of all rows; pass the train part's own rows to keep the held-out ones apart.
    ``only`` names the tables wanted, since every fit is a job of its own; the key is kept if one of them needs it.
    """
    keyed = only is None or not KEYED.isdisjoint(only)
    rows = prepare_houses(houses, features, key if keyed else None)
    train, test = M.train_test_split(rows, key, test_share, seed) if keyed else (None, None)

    def score(model, part: DataFrame, by: Sequence[str] | None) -> DataFrame:
        return M.r2_score(M.predict(model, part, by), "price")

    def own_score(model) -> DataFrame:
        return M.fitted_r2(model, rows)

    def pipeline(**options):
        return M.regression_pipeline(features, "price", degree=2, **options)

    tables = {
        "summary": lambda: describe(rows, ["price", *features]),
        "floors": lambda: value_counts(houses, "floors"),
        "correlation": lambda: pair_correlation(rows, "sqft_above", "price"),
        "prepared": lambda: rows,
        "r2_single": lambda: own_score(M.linear_fit(rows, [single], "price")),
        "r2_all": lambda: own_score(M.linear_fit(rows, features, "price")),
        "r2_expanded": lambda: own_score(pipeline().fit(rows)),
        "r2_ridge_held_out": lambda: score(M.ridge_fit(train, features, "price", alpha), test, features),
        "r2_ridge_expanded_held_out": lambda: score(pipeline(scale=False, ridge_on=train, alpha=alpha).fit(train), test, None),
    }
    return {name: table() for name, table in tables.items() if only is None or name in only}
