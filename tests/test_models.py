"""Fitted models in sessions that did other work before, and what is prepared for them."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarterdeck.operators import models, split


@pytest.fixture
def rows_of_a_rule(spark):
    rows = spark.range(400, numPartitions=3).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
        F.when(F.col("id") % 11 == 0, 0).otherwise((F.col("id") % 7 > 2).cast("int")).alias("label"),
    )
    return models.assemble(rows, ["x", "y"])


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_scores_after_an_observed_write(spark, rows_of_a_rule, kind):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3

    df = rows_of_a_rule
    estimator = models.forest() if kind == "forest" else models.logistic_baseline(400)
    scored = models.score(models.fit(estimator, df), df, ["id", "label"])
    assert scored.filter(F.col("probability").between(0, 1)).count() == 400
    assert scored.filter("prediction = label").count() > 340


def test_a_stored_model_gives_the_same_scores(spark, rows_of_a_rule):
    df = rows_of_a_rule
    for estimator in (models.logistic_baseline(400), models.forest()):
        as_fitted, stored = estimator.fit(df), models.fit(estimator, df)
        values = [models.importance(m, ["x", "y"], spark).collect() if hasattr(m, "featureImportances") else
                  (m.coefficients, m.intercept, m.getRegParam()) for m in (as_fitted, stored)]
        assert values[0] == values[1]
        if hasattr(stored, "trees"):
            assert [t.toDebugString.split("\n", 1)[1] for t in stored.trees] == [
                t.toDebugString.split("\n", 1)[1] for t in as_fitted.trees]


def test_scaling_many_columns_keeps_the_plan_small(spark):
    """The plan behind the moments is not copied into the scaled columns."""
    names = [f"c{i}" for i in range(6)]
    df = spark.range(40).select(
        "id", *[(F.col("id") * (i + 0.5)).alias(c) for i, c in enumerate(names)], F.lit(2.5).alias("same"),
        F.lit(None).cast("double").alias("none"),
    )
    out = split.scale_columns(df, df.filter("id < 30"), dict.fromkeys([*names, "same", "none"]))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "scalar-subquery" not in plan and len(plan) < 5000
    x = np.arange(30.0)
    for row in out.collect():
        assert [row[f"{c}_z"] for c in names] == pytest.approx([(row["id"] - x.mean()) / x.std()] * 6, rel=1e-12)
        assert row["same_z"] == 0.0 and row["none_z"] is None
    nothing = split.scale_columns(df, df.filter("id < 0"), {"c1": None})
    assert nothing.filter("c1_z IS NULL").count() == 40


def test_scaling_many_columns_sums_them_by_one_expression(spark, monkeypatch):
    """One aggregate a number of decimals, however many columns have it; the same bits as for each column by itself."""
    plain, made = split.exact_std_pop, []
    monkeypatch.setattr(split, "exact_std_pop", lambda col, scale: made.append(scale) or plain(col, scale))
    columns = {**dict.fromkeys([f"c{i}" for i in range(5)]), "d0": 2, "d1": 2}
    df = spark.range(50, numPartitions=3).select(
        "id", *[F.when(F.col("id") % 7 != i, F.sin(F.col("id") + i)).alias(f"c{i}") for i in range(5)],
        *[F.when(F.col("id") % 5 != i, F.round(F.cos("id") * 10, 2)).alias(f"d{i}") for i in range(2)],
    )
    out = split.scale_columns(df, df.filter("id < 40"), columns)
    assert sorted(made, key=str) == [2, None]
    fitted = df.filter("id < 40")
    for c, scale in columns.items():
        centre, deviation = fitted.agg(split.exact_mean(F.col(c), scale), plain(F.col(c), scale)).first()
        for row in out.select(c, f"{c}_z").collect():
            assert row[1] == (None if row[0] is None else (row[0] - centre) / deviation)
