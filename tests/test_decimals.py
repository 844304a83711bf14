"""Operators on values with many decimals, as they are, against pandas; and the faults mended beside them."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.text import stored_list_len
from quarterdeck.operators import asof, profile, rolling, rollup, spine
from quarterdeck.sources.files import read_csv
from quarterdeck.sources.payloads import json_rows, sections

PRICES = [0.0042, 0.0047, 0.0041, 0.0049, 0.0044, 0.0043, 0.0048, 0.0050]


def test_rolling_decimals(spark):
    pdf = pd.DataFrame({"k": "a", "t": pd.date_range("2021-01-01", periods=8), "id": range(8), "p": PRICES, "v": [0.1 * i + 0.3 for i in range(8)]})
    out = rolling.indicators(
        spark.createDataFrame(pdf), "k", ["t", "id"], "p", "v", sma=(3,), volatility=(3,), rsi=(3,), volume_ratio=(3,)
    ).orderBy("t").toPandas()
    step = pdf.p.diff()
    gain, loss = step.clip(lower=0).fillna(0).rolling(3, 1).sum(), (-step).clip(lower=0).fillna(0).rolling(3, 1).sum()
    for name, want in {
        "sma_3": pdf.p.rolling(3, 1).mean(), "volatility_3d": pdf.p.rolling(3, 1).std(), "rsi_3": 100 * gain / (gain + loss),
        "volume_ratio_3": pdf.v / pdf.v.rolling(3, 1).mean(),
    }.items():
        pd.testing.assert_series_equal(out[name].astype(float), want, check_names=False, rtol=1e-9)


def test_group_decimals(spark):
    df = spark.createDataFrame([("a", x, w) for x, w in zip((0.1234, 0.1254, 0.1214), (0.4, 0.3, 0.3))], "k string, p double, w double")
    row = rollup.price_rollup(df, ["k"], "p").first()
    assert row["q_avg_close"] == pytest.approx(0.1234, rel=1e-9) and row["q_volatility"] == pytest.approx(0.002, rel=1e-9)
    assert rollup.mean_rollup(df, ["k"], ["p"]).first()["q_p"] == pytest.approx(0.1234, rel=1e-9)
    assert rollup.weighted_mean(df, ["k"], "p", "w").first()["weighted_mean"] == pytest.approx(0.1234, rel=1e-9)


def test_large_and_small_correlate(spark):
    df = spark.range(50_000).select((F.col("id") * 6e7 + 3e12).alias("cap"), (F.col("id") / 125_000).alias("margin"))
    df = df.withColumn("twice", 2 * F.col("margin"))
    got = {r["feature"]: r["corr"] for r in profile.label_correlations(df, ["cap", "twice"], "margin").collect()}
    assert got["cap"] == pytest.approx(1, rel=1e-9) and got["twice"] == pytest.approx(1, rel=1e-9)
    assert rollup.price_rollup(df.withColumn("k", F.lit(1)), ["k"], "cap").first()["q_avg_close"] > 3e12


def test_no_date_finds_nothing(spark):
    left = spark.createDataFrame([("2021-01-02",), (None,)], "t string").select(F.to_timestamp_ntz("t").alias("t"))
    right = spark.createDataFrame([("2021-01-01", 1), ("2021-02-01", 2)], "r string, x int").select(F.to_timestamp_ntz("r").alias("r"), "x")
    assert {r["t"] is None: r["x"] for r in asof.asof_calendar(left, "t", right, "r", ["x"]).collect()} == {False: 1, True: None}


def test_trailing_period_keeps_the_time_of_day(spark):
    df = spark.createDataFrame([("2021-03-31 12:00:00",), ("2021-02-28 11:00:00",), ("2021-02-28 13:00:00",)], "t string")
    df = df.select(F.to_timestamp_ntz("t").alias("t"))
    assert spine.trailing_period(df, "t", 1).count() == 2


@pytest.mark.parametrize("text,n", [
    ("""["it's 5 MW", '10 MW']""", 2), ("['a',]", 1), ("[]", 0), ("['a', 'b, c']", 2), ("[1, 2, 3]", 3), ("junk", 0), (None, 0), ("['a'", 0),
])
def test_stored_list_len(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(stored_list_len(F.col("t"))).first()[0] == n


def test_csv_by_name_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,a\n"x\ny",1\n"say ""z""",2\n')
    out = read_csv(spark, str(tmp_path / "a.csv"), "a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in out] == [(1, "x\ny"), (2, 'say "z"')]


def test_short_payload_and_repeated_section(spark):
    body = spark.createDataFrame([("[[1],[2]]",), (None,), ("[]",)], "body string")
    assert [tuple(r) for r in json_rows(body, "body", [], {"x": "int"}).collect()] == [(2,)]
    parts = spark.createDataFrame([(1, "s", "b"), (1, "s", "a")], "i int, section string, text string")
    assert [r["text"] for r in sections(parts, ["i"], "section", "text", ["s", "t"]).collect()] == ["a\nb", ""]
