"""Landed CSV files through to the end-to-end tables."""

import datetime as dt

import pytest

from quarterdeck.plans.panel import quarterly_panel
from quarterdeck.plans.promises import promise_matrix
from quarterdeck.sources import inputs

FILES = {
    "msft": """Date,Open,High,Low,Close,Volume,Dividends
2021-01-04 00:00:00-05:00,10,12,9,11,100,0.0
2021-01-05T00:00:00-05:00,11,13,10,12.5,200,0.0
2021-04-01,12,14,11,13,,0.0
""",
    "dlr": """Date,Close,Volume
2021-01-04,50,7
""",
    "ratios": "ticker,sector,beta,market_cap\nMSFT,Tech,0.9,2e12\n",
    "macro": "date,Real GDP,Fed Funds Rate\n2021-01-01,10,0.25\n2021-02-01,NaN,0.35\n2021-04-01,11,0.1\n",
    "queue": "iso,Queue Date,capacity\npjm,2021-01-09,5\nPJM,TBD,6\nPJM,,7\nCAISO,2021-02-01 12:00:00,8\n",
    "promises": """company_ticker,company_tier,iso,location,announcement_date,target_date,promised_mw,promise_kept
TICKER_MSFT,TIER_1,PJM,"Ashburn, VA",2021-01-02,2021-03-01,100,1
TICKER_DLR,TIER_2,CAISO,"Santa Clara, CA",2021-02-02,unknown,50,
""",
}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    for name, body in FILES.items():
        (folder / f"{name}.csv").write_text(body)
    return {name: str(folder / f"{name}.csv") for name in FILES}


def test_prices_per_ticker(spark, landed, rows):
    df = inputs.prices_by_ticker(spark, {"MSFT": landed["msft"], "DLR": landed["dlr"]})
    got = rows(df.select("ticker", "company_name", "Date", "Close", "Volume", "Open"))
    assert got[0] == ("DLR", "Digital Realty Trust", dt.datetime(2021, 1, 4), 50.0, 7.0, None)
    assert got[1] == ("MSFT", "Microsoft", dt.datetime(2021, 1, 4, 5), 11.0, 100.0, 10.0)
    assert got[3][2:5] == (dt.datetime(2021, 4, 1), 13.0, None)


def test_types_by_name(spark, landed):
    df = inputs.ratios(spark, landed["ratios"])
    assert dict(df.dtypes) == {"ticker": "string", "sector": "string", "beta": "double", "market_cap": "double"}


def test_strict_and_lenient_dates(spark, landed, rows):
    days = [r[0] for r in inputs.queue(spark, landed["queue"]).select("Queue Date").collect()]
    assert days == [dt.datetime(2021, 1, 9), None, None, dt.datetime(2021, 2, 1, 12)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        inputs.queue(spark, landed["queue"], lenient=False).collect()


def test_from_files_to_tables(spark, landed):
    prices = inputs.prices_by_ticker(spark, {"MSFT": landed["msft"], "DLR": landed["dlr"]})
    rest = [inputs.ratios(spark, landed["ratios"]), inputs.macro(spark, landed["macro"]), inputs.queue(spark, landed["queue"])]
    promises = inputs.promises(spark, landed["promises"])
    panel = {(r["ticker"], r["quarter"]): r for r in quarterly_panel(prices, *rest, promises).collect()}
    row = panel["MSFT", "2021Q1"]
    assert (row["q_avg_close"], row["q_total_volume"], row["beta"], row["Real GDP"]) == (11.75, 300.0, 0.9, 10.0)
    assert (row["Fed Funds Rate"], row["queue_PJM"], row["promise_kept"]) == (pytest.approx(0.3), 1, 1)
    assert len(panel) == 4 and panel["DLR", "2021Q2"]["q_avg_close"] is None
    matrix = {r["ticker_clean"]: r for r in promise_matrix(promises, prices, *rest).collect()}
    assert matrix["MSFT"]["location"] == "Ashburn, VA" and matrix["DLR"]["iso_queue_depth"] == 1
    assert matrix["DLR"]["target_date"] is None and matrix["DLR"]["promise_kept"] is None
