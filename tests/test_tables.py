"""Filling, splitting, metrics, profiles, joins, labels and roll-ups on small tables."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import fill, joins, metrics, profile, rollup, split
from quarterdeck.operators.skew import HOT_ROWS


# Medians.


@pytest.mark.parametrize("values", [[3.0, 1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [5.0], [2.0] * 9 + [7.5], [-1.25, -1.25, 0.0, 9.0]])
@pytest.mark.parametrize("scale", [2, None])
def test_column_medians(spark, values, scale):
    df = spark.createDataFrame([(v, -v) for v in values] + [(None, 1.0)], "a double, b double")
    row = fill.column_medians(df, ["a", "b"], scale).first()
    assert row["a"] == np.median(values) and row["b"] == np.median([-v for v in values] + [1.0])


@pytest.mark.parametrize("accuracy", [10, 50, 1000])
def test_coarse_brackets_still_give_exact_medians(spark, accuracy):
    rng = random.Random(accuracy)
    values = [round(rng.lognormvariate(3, 2), 2) for _ in range(3000)] + [4.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(7)
    assert fill.column_medians(df, ["a"], 2, accuracy).first()["a"] == pytest.approx(np.median(values), abs=1e-12)


def test_group_medians_of_hot_groups(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, 3]), round(rng.gauss(0, 9), 2), float(rng.randrange(9))) for _ in range(2000)]
    data = [(k, a if rng.random() > 0.1 else None, b) for k, a, b in data]
    data += [(4, None, 1.0), (4, None, None), (None, None, 2.0)]
    df = spark.createDataFrame(data, "k long, a double, b double")
    plain = rows(fill.fill_group_median(df, "k", ["a", "b"], None, 2))
    for hot_rows in (None, 1, 300, 900):
        assert rows(fill.fill_group_median(df, "k", ["a", "b"], None, 2, hot_rows, accuracy=100)) == plain
    frame = pd.DataFrame(data, columns=list("kab"))
    want = frame.groupby("k").median()
    got = {r["k"]: r["a"] for r in fill.large_group_medians(df.filter("k < 4"), "k", ["a"], 2).collect()}
    assert got == {k: pytest.approx(want.loc[k, "a"], abs=1e-9) for k in (1, 2, 3)}
    assert [r for r in plain if r[0] == 4] == [(4, None, 1.0), (4, None, 1.0)]
    assert [r for r in plain if r[0] is None] == [(None, None, 2.0)]


def test_fill_group_median_then_default(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, None)], "k string, v double")
    assert rows(fill.fill_group_median(df, "k", ["v"])) == [(None, 0.0), ("a", 1.0), ("a", 2.5), ("a", 4.0), ("b", 0.0)]


def test_two_stage_uses_the_filled_column(spark, rows):
    # Group a becomes [1, 1, 1, 9]; the median of all filled values is 1, not that of the raw ones.
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", None), ("a", 1.0), ("c", 9.0), ("c", 9.0), ("b", None)], "k string, v double")
    assert rows(fill.fill_two_stage(df, "k", ["v"]).filter("k = 'b'")) == [("b", 1.0)]
    full = df.fillna(0.0)
    assert fill.fill_two_stage(full, "k", ["v"]).count() == 7


def test_fill_on_train_only(spark, rows):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 100.0), (1, None)], "test int, v double")
    assert rows(fill.fill_column_median(df, ["v"], df.filter("test = 0"))) == [(0, 1.0), (0, 3.0), (1, 2.0), (1, 100.0)]
    assert rows(fill.fill_column_median(df, ["v"]).filter("test = 1")) == [(1, 3.0), (1, 100.0)]


def test_fill_zero_leaves_text_and_labels(spark):
    df = spark.createDataFrame([(None, None, None)], "a double, s string, label int")
    assert tuple(fill.fill_zero(df, exclude=["label"]).first()) == (0.0, None, None)


# Split, scaling, encoding.


def test_split_sizes_and_repeatability(spark, rows):
    df = spark.createDataFrame([(i, "x" if i < 33 else "y" if i < 37 else "z") for i in range(187)], "id long, label string")
    out = split.stratified_split(df, "label", "id")
    sizes = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    assert sizes == {("x", 0): 27, ("x", 1): 6, ("y", 0): 4, ("z", 0): 120, ("z", 1): 30}
    assert rows(split.stratified_split(df.repartition(5), "label", "id")) == rows(out)
    assert rows(split.stratified_split(df, "label", "id", seed=7)) != rows(out)


def test_split_equals_ranking_by_hash(spark, rows):
    from pyspark.sql import Window as W

    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    hashed = F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))
    rank = F.row_number().over(W.partitionBy("label").orderBy(hashed))
    size = F.count("*").over(W.partitionBy("label"))
    want = df.select("id", "label", (rank <= F.floor(size * 0.2)).cast("int"))
    assert rows(split.stratified_split(df, "label", "id")) == rows(want)


def test_scaling_is_fitted_on_train(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 9.0, 5.0)], "test int, a double, c double")
    out = split.scale_columns(df, df.filter("test = 0"), {"a": 0, "c": 0}).orderBy("a").collect()
    assert [r["a_z"] for r in out] == [-1.0, 1.0, 7.0] and [r["c_z"] for r in out] == [0.0, 0.0, 0.0]


def test_label_codes(spark, rows):
    df = spark.createDataFrame([("SPP",), ("CAISO",), ("PJM",), ("CAISO",)], "iso string")
    assert rows(split.encode_labels(df, ["iso"])) == [("CAISO", 0), ("CAISO", 0), ("PJM", 1), ("SPP", 2)]
    model = split.fit_label_codes(df, ["iso"])
    assert rows(split.encode_labels(spark.createDataFrame([("NEW",)], "iso string"), ["iso"], model)) == [("NEW", 3)]


def test_one_hot(spark, rows):
    df = spark.createDataFrame([("TIER_1",), (None,)], "tier string")
    assert rows(split.one_hot(df, "tier", ["TIER_1", "TIER_2"]).drop("tier")) == [(0, 0), (1, 0)]


# Metrics.


def brute_auc(data):
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("cells", [2, 16, 1024])
def test_roc_auc(spark, cells):
    rng = random.Random(cells)
    data = [(int(rng.random() < 0.4), float(rng.choice([rng.randrange(12), 3]))) for _ in range(400)]
    row = metrics.roc_auc(spark.createDataFrame(data, "y int, s double"), "y", "s", cells).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(data), rel=1e-14)


def test_roc_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert tuple(metrics.roc_auc(df, "y", "s").first()) == (2, 0, None)


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y int, p int")
    row = metrics.classifier_metrics(df, "y", "p").first()
    assert (row["n"], row["accuracy"], row["precision"], row["recall"]) == (10, 0.7, 0.6, 0.75)
    assert row["f1"] == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    none = metrics.classifier_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y int, p int")
    got = {r["class"]: r for r in metrics.class_report(df, "y", "p").collect()}
    assert (got["0"]["precision"], got["0"]["support"]) == (0.8, 6)
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 4 / 6) / 2)
    assert got["weighted avg"]["precision"] == pytest.approx((0.6 * 4 + 0.8 * 6) / 10)


# Profiles.


def test_null_profile(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, c string")
    assert rows(profile.null_profile(df)) == [("b", 2), ("c", 1)]
    assert profile.columns_with_nulls(df, ["a", "b", "c"]) == ["b", "c"]


def test_class_weights(spark, rows):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert rows(profile.class_weights(df, "y")) == [(0, 3, 4 / 6), (1, 1, 2.0)]
    assert profile.with_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(4.0)


def test_correlations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 50, 300), rng.integers(0, 50, 300)
    df = spark.createDataFrame([(int(a), int(b), 7, int(a) * 3 + 1) for a, b in zip(x, y)], "x int, y int, flat int, copy int")
    got = {r["feature"]: r["corr"] for r in profile.label_correlations(df, ["x", "flat"], "y").collect()}
    assert got["x"] == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-12) and got["flat"] is None
    assert [r[0] for r in profile.redundant_features(df, ["x", "y", "copy"]).collect()] == ["copy"]


def test_require_rows(spark):
    assert profile.require_rows(spark.range(5), 5) == 5
    with pytest.raises(ValueError, match="5 rows"):
        profile.require_rows(spark.range(5), 6)


# Joins and labels.


def test_null_keys_do_not_match(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 9), ("a", 8)], "q string, y int")
    assert rows(joins.lookup(left, right, {"k": "q"})) == [(None, 1, None), ("a", 2, 8)]


def test_overlay_and_cover(spark, rows):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    right = spark.createDataFrame([("a", 9.0), ("b", None)], "k string, v double")
    assert rows(joins.overlay(left, right, ["k"], ["v"])) == [("a", 9.0), ("b", 2.0), ("c", 3.0)]
    names = left.select("k")
    assert joins.cover(names, right, "k", "keep").count() == 3 and joins.cover(names, right, "k", "drop").count() == 2
    with pytest.raises(ValueError):
        joins.cover(names, right, "k", "other")


EVENTS = [
    ("MSFT", "2024Q1", dt.datetime(2023, 5, 1), None, 10.0),
    ("MSFT", "2024Q1", dt.datetime(2023, 6, 1), 0, 20.0),
    ("MSFT", "2024Q1", dt.datetime(2023, 7, 1), 1, 0.1),
    ("DLR", None, dt.datetime(2023, 7, 1), 1, 5.0),
    (None, "2024Q1", dt.datetime(2023, 7, 1), 1, 5.0),
]


@pytest.mark.parametrize(
    "policy, want",
    [
        ("fanout", [(None, 10.0, 0), (0, 20.0, 1), (1, 0.1, 1)]),
        ("first", [(None, 10.0, 0)]),
        ("total", [(0, 20.1, 1)]),
    ],
)
def test_label_policies(spark, rows, policy, want):
    events = spark.createDataFrame(EVENTS, "ticker string, quarter string, at timestamp_ntz, kept int, mw double")
    panel = spark.createDataFrame([("MSFT", "2024Q1"), ("DLR", "2024Q1")], "ticker string, quarter string")
    keys = ["ticker", "quarter"]
    labels = joins.label_rows(events, keys, policy, ["at"], "kept", "mw")
    out = joins.attach_labels(panel, labels, keys, "kept", "mw")
    assert rows(out.filter("ticker = 'MSFT'").select("kept", "mw", "has_promise")) == want
    assert rows(out.filter("ticker = 'DLR'").select("kept", "mw", "has_promise")) == [(None, 0.0, 0)]
    assert joins.unmatched(events, panel, keys).count() == 2


# Roll-ups.


def test_price_rollup_of_one_day_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 5.0, 3)], "k string, c double, v long")
    row = rollup.price_rollup(df, ["k"], "c", "v").first()
    assert (row["q_avg_close"], row["q_volatility"], row["q_total_volume"]) == (5.0, 0.0, 3.0)


def test_queue_unifies_spelling_before_the_pivot(spark, rows):
    df = spark.createDataFrame([("pjm", "q1"), ("PJM", "q1"), ("spp", "q2"), (None, "q1"), ("PJM", None)], "iso string, q string")
    depth = rollup.queue_depth(df, "iso", F.col("q"))
    assert rows(depth) == [("PJM", "q1", 2), ("SPP", "q2", 1)]
    assert rows(rollup.queue_wide(depth, ["PJM", "SPP"])) == [("q1", 2, 0), ("q2", 0, 1)]
    assert rows(rollup.queue_total(depth)) == [("q1", 2), ("q2", 1)]


def test_last_values_skip_nulls_per_column(spark, rows):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, None, 7), (None, 3, 1, 1)], "k string, t int, x int, y int")
    assert rows(rollup.latest_per_key(df, "k", ["t"], ["x", "y"])) == [("a", 5, 7)]


def test_latest_rows(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, t int")
    assert rows(rollup.latest_rows(df, "k", [F.desc("t")], 3)) == [("a", 47), ("a", 48), ("a", 49), ("b", 1)]


def test_calendar_rollup(spark, rows):
    df = spark.createDataFrame(
        [(dt.datetime(2021, 1, 1), 1.0, 2.0), (dt.datetime(2021, 2, 1), None, 4.0)], "date timestamp_ntz, g double, r double"
    )
    assert rows(rollup.calendar_rollup(df, F.quarter("date"), "date", ["g"], {"r": 2})) == [(1, 1.0, 3.0)]


def test_weighted_mean_and_rates(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 3), ("a", None, 9), ("b", 1.0, 0)], "k string, x double, w int")
    assert rows(rollup.weighted_mean(df, ["k"], "x", "w")) == [("a", 3.25), ("b", None)]
    flags = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), ("a", 1), ("a", 1)], "k string, kept int")
    assert rows(rollup.rate_by(flags, ["k"], "kept")) == [("a", 4, 0.75, 0.25)]


def test_default_threshold_is_large():
    assert HOT_ROWS >= 100_000


def test_codes_of_nulls_numbers_and_odd_names(spark):
    df = spark.createDataFrame([("b", 10), (None, 9), ("a", None), ("b", 10)], "`my col` string, n int")
    out = split.encode_labels(df, ["my col", "n"])
    assert out.columns == ["my col", "n", "my col_encoded", "n_encoded"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == [(0, 2), (1, 0), (1, 0), (2, 1)]
    assert split.encode_labels(df.limit(0), ["n"]).count() == 0


def test_small_classes_have_a_test_row_on_request(spark):
    df = spark.range(25).select("id", F.when(F.col("id") < 4, 1).when(F.col("id") < 5, 2).otherwise(0).alias("y"))
    marked = split.stratified_split(df, "y", "id", at_least_one=True).filter("is_test = 1")
    assert {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()} == {0: 4, 1: 1}
    assert split.stratified_split(df, "y", "id").filter("is_test = 1 AND y = 1").count() == 0
