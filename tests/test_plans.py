"""The end-to-end tables on small invented data in the shape of the real inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterdeck.plans.analyst import enrich_panel, latest_recommendations, price_targets
from quarterdeck.plans.daily import DAILY_COLUMNS, daily_features
from quarterdeck.plans.panel import quarterly_panel
from quarterdeck.plans.promises import company_tier, promise_matrix, tier_columns, with_timing
from quarterdeck.plans.rebuild import full_panel
from quarterdeck.plans.training import compare_models, prepare

D = dt.datetime


@pytest.fixture(scope="module")
def inputs(spark):
    days = [D(2021, 1, 4), D(2021, 1, 5), D(2021, 2, 1), D(2021, 4, 1), D(2021, 7, 1)]
    prices = [("MSFT", d, 100.0 + i, 101.0, 99.0, 100.5, 1000 + i) for i, d in enumerate(days)]
    prices += [("DLR", d, 50.0, 51.0, 49.0, 50.0, 10) for d in days[:4]] + [("IRM", days[0], 30.0, 31.0, 29.0, 30.0, 5)]
    ratio = [("MSFT", 2e12, 0.3, 0.5), ("DLR", 3e10, None, 1.5)]
    macro = [
        (D(2021, 1, 1), 10.0, 1.0, 0.1, 6.0), (D(2021, 2, 1), None, 1.1, 0.2, 6.2), (D(2021, 7, 1), None, 1.2, 0.4, 5.0),
    ]
    queue = [("pjm", D(2021, 1, 9)), ("PJM", D(2021, 2, 9)), ("Caiso", D(2021, 4, 9)), ("PJM", None)]
    promises = [
        ("TICKER_MSFT", "TIER_1", "PJM", D(2021, 1, 2), D(2021, 1, 20), 100.0, 1, 60000.0),
        ("TICKER_MSFT", "TIER_1", "PJM", D(2021, 1, 3), D(2021, 2, 20), 50.0, 0, 61000.0),
        ("TICKER_DLR", "TIER_2", "CAISO", D(2021, 4, 3), D(2021, 4, 20), 25.0, None, None),
        ("TICKER_XYZ", "TIER_4", "SPP", D(2021, 4, 3), D(2021, 4, 20), 9.0, 1, None),
        ("CAISO", "TICKER_DLR", None, D(2021, 4, 3), None, 7.0, 1, None),
    ]
    return {
        "prices": spark.createDataFrame(
            prices, "ticker string, Date timestamp_ntz, Close double, High double, Low double, Open double, Volume long"
        ),
        "ratios": spark.createDataFrame(ratio, "ticker string, market_cap double, profit_margin double, beta double"),
        "macro": spark.createDataFrame(
            macro, "date timestamp_ntz, `Real GDP` double, `Core CPI` double, `Fed Funds Rate` double, `Unemployment Rate` double"
        ),
        "queue": spark.createDataFrame(queue, "iso string, `Queue Date` timestamp_ntz"),
        "promises": spark.createDataFrame(
            promises,
            "company_ticker string, company_tier string, iso string, announcement_date timestamp_ntz, target_date timestamp_ntz, "
            "promised_mw double, promise_kept int, median_income double",
        ),
    }


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_quarterly_panel(inputs):
    panel = quarterly_panel(**inputs)
    got = by_key(panel, "ticker", "quarter")
    assert len(got) == 3 * 3 and panel.columns[:2] == ["ticker", "quarter"]
    first = got["MSFT", "2021Q1"]
    assert (first["q_avg_close"], first["q_volatility"], first["q_total_volume"]) == (101.0, 1.0, 3003.0)
    assert (first["Real GDP"], first["Core CPI"], first["Fed Funds Rate"]) == (10.0, 1.1, pytest.approx(0.15))
    assert (first["queue_PJM"], first["queue_CAISO"], first["queue_SPP"]) == (2, 0, 0)
    assert (first["promise_kept"], first["promised_mw"], first["has_promise"]) == (1, 150.0, 1)
    third = got["MSFT", "2021Q3"]
    assert (third["Real GDP"], third["q_volatility"], third["has_promise"], third["promised_mw"]) == (10.0, 0.0, 0, 0.0)
    empty = got["IRM", "2021Q2"]
    assert empty["q_avg_close"] is None and empty["beta"] is None
    assert got["DLR", "2021Q2"]["promise_kept"] is None and got["DLR", "2021Q2"]["has_promise"] == 0


def test_panel_options(inputs):
    filled = by_key(quarterly_panel(**inputs, zero_fill=True), "ticker", "quarter")
    assert filled["IRM", "2021Q2"]["q_avg_close"] == 0.0 and filled["IRM", "2021Q2"]["promise_kept"] is None
    assert quarterly_panel(**inputs, policy="fanout").count() == 10
    assert by_key(quarterly_panel(**inputs, policy="first"), "ticker", "quarter")["MSFT", "2021Q1"]["promised_mw"] == 100.0


def test_daily_features(inputs):
    daily = daily_features(inputs["prices"], inputs["macro"], inputs["queue"], inputs["promises"])
    assert daily.columns == DAILY_COLUMNS
    got = by_key(daily, "ticker", "Date")
    assert len(got) == inputs["prices"].count() - 3  # the first row of each company
    row = got["MSFT", D(2021, 4, 1)]
    assert (row["sma_20"], row["Fed Funds Rate"], row["iso_queue_depth"]) == (101.5, 0.2, 1)
    assert (row["promise_label"], row["has_promise"]) == (0, 0)
    assert got["MSFT", D(2021, 2, 1)]["promise_label"] == 1
    assert got["DLR", D(2021, 1, 5)]["rsi_14"] is None and got["MSFT", D(2021, 1, 5)]["rsi_14"] == 100.0


def test_daily_features_with_hot_entities(inputs, rows):
    parts = (inputs["prices"], inputs["macro"], inputs["queue"], inputs["promises"])
    assert rows(daily_features(*parts, hot_rows=1)) == rows(daily_features(*parts))


def test_promise_matrix(inputs):
    matrix = promise_matrix(inputs["promises"], inputs["prices"], inputs["ratios"], inputs["macro"], inputs["queue"])
    got = by_key(matrix, "company_ticker", "promised_mw")
    assert len(got) == 5
    row = got["TICKER_MSFT", 100.0]
    assert (row["ticker_clean"], row["announcement_quarter"], row["q_close"], row["iso_queue_depth"]) == ("MSFT", "2021Q1", 101.0, 2)
    assert (row["Real GDP"], row["profit_margin"]) == (10.0, 0.3)
    shifted = got["CAISO", 7.0]
    assert (shifted["ticker_clean"], shifted["q_close"], shifted["iso_queue_depth"]) == ("DLR", 50.0, 0)
    assert shifted["Real GDP"] is None  # the second quarter has no macro row


def test_tiers_and_timing(spark, rows):
    df = spark.createDataFrame([(2e12,), (5e8,), (None,)], "market_cap double")
    tiers = tier_columns(df.select(company_tier(F.col("market_cap")).alias("company_tier")))
    assert rows(tiers.select("TIER_1", "TIER_4")) == [(0, 0), (0, 1), (1, 0)]
    one = spark.createDataFrame([(D(2021, 5, 1), D(2022, 2, 1))], "announcement_date timestamp_ntz, target_date timestamp_ntz")
    row = with_timing(one).first()
    assert tuple(row)[2:] == (2, 5, 7, 276, 9, 1, 3)


def test_full_panel(spark, inputs):
    analyst = spark.createDataFrame([("MSFT", 10), ("DLR", None)], "ticker string, strongBuy long")
    panel = full_panel(
        inputs["prices"], inputs["ratios"], inputs["macro"], analyst, inputs["promises"], tickers=["MSFT", "DLR", "ZZZ"]
    )
    got = by_key(panel, "ticker", "quarter")
    assert len(got) == 9
    assert got["MSFT", "2021Q1"]["Close"] == 102.0 and got["DLR", "2021Q3"]["Close"] == 50.0
    assert got["ZZZ", "2021Q1"]["strongBuy"] == 10.0  # median of the column as filled
    assert got["ZZZ", "2021Q1"]["promise_kept"] is None and got["MSFT", "2021Q1"]["promised_mw"] == 150.0
    assert got["MSFT", "2021Q1"]["median_income"] == 60000.0


def test_analyst_columns(spark, inputs):
    recs = spark.createDataFrame(
        [("MSFT", "0m", 5, 4, 3, 2, 1), ("MSFT", "-3m", 9, 9, 9, 9, 9)],
        "ticker string, period string, strongBuy long, buy long, hold long, sell long, strongSell long",
    )
    targets = spark.createDataFrame(
        [("MSFT", 400.0, 600.0, 300.0, 500.0, 490.0), ("DLR", 0.0, 1.0, 1.0, 1.0, 1.0)],
        "ticker string, current double, high double, low double, mean double, median double",
    )
    panel = quarterly_panel(**inputs)
    out = enrich_panel(panel, latest_recommendations(recs), price_targets(targets))
    got = by_key(out, "ticker", "quarter")
    assert len(got) == 9
    assert (got["MSFT", "2021Q1"]["strongBuy"], got["MSFT", "2021Q1"]["target_premium_pct"]) == (5.0, 25.0)
    assert (got["DLR", "2021Q1"]["buy"], got["DLR", "2021Q1"]["target_premium_pct"]) == (0.0, 0.0)


def test_models_learn_a_rule(spark):
    df = spark.range(240).select(
        "id", (F.col("id") % 10).alias("a"), (F.col("id") % 7).alias("b"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 10 > 4).cast("int")).alias("kept"),
    )
    data = prepare(df, {"a": 0, "b": 0}, "kept", "id")
    labelled = df.filter("kept IS NOT NULL").count()
    assert data.train.count() + data.test.count() == labelled
    table = compare_models(data, "id").collect()
    assert [r["model"] for r in table] == ["Logistic Regression", "Random Forest", "Boosted Trees"]
    assert all(r["accuracy"] > 0.9 and 0.9 < r["roc_auc"] <= 1.0 for r in table)
