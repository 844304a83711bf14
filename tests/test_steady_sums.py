"""Sums of doubles as they are: the same bits for every order, and right beside exact arithmetic."""

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_mean, exact_std, exact_std_pop, exact_sum
from quarterdeck.operators import rollup

CASES = {
    "six_decimals": [round(random.Random(1).uniform(-9e4, 9e4), 6) for _ in range(997)],
    "cancel": [1e16, 1.0, -1e16, 1e-9, 3.5, -3.5],
    "negative": [-0.001, -0.002, -1e-12],
    "wide": [random.Random(2).choice([-1, 1]) * 2.0 ** random.Random(i).uniform(-38, 45) for i in range(500)],
    "large_beside_spread": [3e12 + i * 0.25 for i in range(301)],
    "equal": [0.1] * 17,
    "one": [2.5],
    "zeros": [0.0, -0.0],
    **{f"many_{i}": [random.Random(i * 100 + j).uniform(-1, 9) for j in range(i + 2)] for i in range(80)},
}


def _aggregates():
    x = F.col("x")
    return [f(x).alias(n) for n, f in (("total", exact_sum), ("mean", exact_mean), ("std", exact_std), ("pop", exact_std_pop))]


def _exact_variance(values, ddof):
    whole = [Fraction(v) for v in values]
    mean = sum(whole) / len(whole)
    return float(sum((v - mean) ** 2 for v in whole) / (len(whole) - ddof))


def test_same_bits_in_any_order(spark):
    runs = []
    for parts, arrange in ((1, list), (3, lambda v: v[::-1]), (7, sorted)):
        rows = [(name, v) for name, values in CASES.items() for v in arrange(values)]
        df = spark.createDataFrame(rows, "name string, x double").repartition(parts)
        runs.append({r["name"]: tuple(r)[1:] for r in df.groupBy("name").agg(*_aggregates()).collect()})
    assert runs[0] == runs[1] == runs[2]
    for name, values in CASES.items():
        total, mean, std, pop = runs[0][name]
        assert total == math.fsum(values) and mean == math.fsum(values) / len(values), name
        assert pop == pytest.approx(math.sqrt(_exact_variance(values, 0)), rel=1e-13, abs=0), name
        assert std == (None if len(values) == 1 else pytest.approx(math.sqrt(_exact_variance(values, 1)), rel=1e-13, abs=0)), name


def test_odd_numbers(spark):
    cases = {
        "none": [None, None], "some": [None, 1.5, 2.5], "nan": [1.0, float("nan")], "infinite": [1.0, float("inf")],
        "tiny": [1e-30, 3e-30], "huge": [1e300, 1.0],
    }
    df = spark.createDataFrame([(k, v) for k, values in cases.items() for v in values], "k string, x double")
    got = {r["k"]: r for r in df.groupBy("k").agg(*_aggregates()).collect()}
    assert tuple(got["none"])[1:] == (None, None, None, None)
    assert got["some"]["total"] == 4.0 and got["some"]["mean"] == 2.0
    assert math.isnan(got["nan"]["total"]) and math.isnan(got["nan"]["std"])
    assert got["infinite"]["total"] == float("inf") and got["huge"]["total"] == 1e300
    assert got["tiny"]["total"] == pytest.approx(4e-30)
    assert got["tiny"]["std"] == pytest.approx(statistics.stdev(cases["tiny"]))


def test_groups_and_weights(spark):
    rows = [(k, v, abs(v) / 7 + 0.1) for k in ("a", "b") for v in CASES["six_decimals"]]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    got = {tuple(r) for n in (1, 5) for r in rollup.weighted_mean(df.repartition(n), ["k"], "x", "w").collect()}
    want = math.fsum(v * w for _, v, w in rows[:997]) / math.fsum(w for _, _, w in rows[:997])
    assert got == {("a", want), ("b", want)}
