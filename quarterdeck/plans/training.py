"""From a labelled feature table to trained and evaluated models."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import MACRO_LAST, MACRO_MEAN
from quarterdeck.operators.fill import fill_column_median
from quarterdeck.operators.models import (
    assemble,
    boosted_trees,
    evaluate,
    fit,
    forest,
    importance,
    logistic_baseline,
    ridge_gradient,
    score,
)
from quarterdeck.operators.profile import columns_with_nulls
from quarterdeck.operators.split import encode_labels, scale_columns, stratified_split
from quarterdeck.plans.promises import with_timing
from quarterdeck.session import materialize

SUFFIX = "_z"


@dataclass
class Prepared:
    """Train and test rows with raw and scaled feature vectors."""

    train: DataFrame
    test: DataFrame
    features: list[str]


def prepare(
    df: DataFrame,
    features: Mapping[str, int | None],
    label: str,
    key: str,
    test_percent: int = 20,
    missing: str = "zero",
    fit_on: str = "train",
) -> Prepared:
    """Labelled rows only, missing features filled, split by class, scaled on the training rows.

    ``features`` maps a column to its number of decimals, or None. ``missing`` is 'zero'
    or 'median'; medians come from the training rows, or with ``fit_on`` 'all'
    from the test rows too. The narrow feature
    table is written once for the split and the scaling, the vectors once for the
    fits, so that the texts behind the features are read a single time.
    """
    names = list(features)
    rows = df.filter(F.col(label).isNotNull()).select(
        key, F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in names]
    )
    if missing not in ("zero", "median") or fit_on not in ("train", "all"):
        raise ValueError("missing is 'zero' or 'median', fit_on is 'train' or 'all'")
    rows = materialize(rows)
    marked = stratified_split(rows, "label", key, test_percent)
    if missing == "zero":
        marked = marked.fillna(0, subset=names)
    else:
        fitted = marked if fit_on == "all" else marked.filter("is_test = 0")
        marked = fill_column_median(marked, columns_with_nulls(rows, names), fitted)
    train = marked.filter("is_test = 0")
    scaled = scale_columns(marked, train, features, SUFFIX)
    vectors = assemble(assemble(scaled, names, "raw"), [c + SUFFIX for c in names], "scaled")
    vectors = materialize(vectors.select(key, "label", "is_test", "raw", "scaled"))
    return Prepared(vectors.filter("is_test = 0"), vectors.filter("is_test = 1"), names)


def train_logistic(data: Prepared, key: str) -> DataFrame:
    model = fit(logistic_baseline(data.train.count(), features="scaled"), data.train)
    return score(model, data.test, [key, "label"])


def logistic_slopes(data: Prepared) -> DataFrame:
    """How far from flat the loss is at the fitted logistic model, per scaled feature."""
    model = fit(logistic_baseline(data.train.count(), features="scaled"), data.train)
    return ridge_gradient(model, data.train, data.features, vector="scaled")


def train_forest(data: Prepared, key: str) -> DataFrame:
    return score(fit(forest(features="raw"), data.train), data.test, [key, "label"])


def train_boosted(data: Prepared, key: str, depth: int = 3) -> DataFrame:
    return score(fit(boosted_trees(depth, features="raw"), data.train), data.test, [key, "label"])


def forest_importance(data: Prepared, top: int | None = 10) -> DataFrame:
    model = fit(forest(features="raw"), data.train)
    return importance(model, data.features, data.train.sparkSession, top)


# Fixed values. Features of the promise model that are numbers already.
PROMISE_FEATURES = ["promised_mw", "days_to_target", *MACRO_LAST, *MACRO_MEAN, "iso_queue_depth"]


def promise_features(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """The promise matrix with region and tier as codes, and the model's feature names."""
    # Written once: the codes and the training read it several times.
    matrix = materialize(matrix.fillna("", subset=["iso", "company_tier"]))
    coded = encode_labels(matrix, ["iso", "company_tier"])
    if "days_to_target" not in coded.columns:
        coded = with_timing(coded)
    names = [c for c in PROMISE_FEATURES if c in coded.columns]
    return coded, [*names, "iso_encoded", "company_tier_encoded"]


def promise_model(matrix: DataFrame, key: str, fit_on: str = "train") -> DataFrame:
    """Boosted trees of depth four on the promise matrix: scored test promises."""
    coded, names = promise_features(matrix)
    data = prepare(coded, dict.fromkeys(names), "promise_kept", key, missing="median", fit_on=fit_on)
    return train_boosted(data, key, depth=4)


def compare_models(data: Prepared, key: str) -> DataFrame:
    """One row of test metrics per model. Scores are written once, the metrics read them several times."""
    scored = {
        "Logistic Regression": train_logistic(data, key),
        "Random Forest": train_forest(data, key),
        "Boosted Trees": train_boosted(data, key),
    }
    rows = [evaluate(materialize(df), name) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, rows)
