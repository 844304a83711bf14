"""Rolling windows and as-of joins against pandas, with and without hot entities."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import asof, rolling, spine
from quarterdeck.operators.skew import HOT_ROWS, split_series

ALL = dict(sma=(3, 7), volatility=(5,), momentum=(4,), rsi=(6,), volume_ratio=(5,))
DAY0 = dt.datetime(2021, 1, 1)


def series(seed=0, n=240):
    """A third of the rows belong to one entity; several rows may share a day."""
    rng = np.random.default_rng(seed)
    entity = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    days = rng.integers(0, 40, n)
    price = np.round(rng.uniform(1, 50, n), 2)
    price[rng.random(n) < 0.1] = np.nan
    volume = rng.integers(0, 5, n)
    frame = pd.DataFrame({"k": entity, "t": [DAY0 + dt.timedelta(days=int(x)) for x in days], "id": range(n), "p": price, "v": volume})
    return frame.sort_values(["k", "t", "id"]).reset_index(drop=True)


def expected(frame):
    g = frame.groupby("k")
    out = frame.copy()
    for n in (3, 7):
        out[f"sma_{n}"] = g["p"].transform(lambda x: x.rolling(n, min_periods=1).mean())
    out["volatility_5d"] = g["p"].transform(lambda x: x.rolling(5, min_periods=2).std())
    base = g["p"].shift(4)
    out["momentum_4d"] = frame["p"] / base - 1
    delta = g["p"].diff()
    gain = delta.where(delta > 0, 0).groupby(frame["k"]).transform(lambda x: x.rolling(6, min_periods=1).sum())
    loss = (-delta.where(delta < 0, 0)).groupby(frame["k"]).transform(lambda x: x.rolling(6, min_periods=1).sum())
    out["rsi_6"] = 100 * gain / (gain + loss).where((gain + loss).abs() > 1e-9)
    mean = g["v"].transform(lambda x: x.rolling(5, min_periods=1).mean())
    out["volume_ratio_5"] = frame["v"] / mean.where(mean != 0)
    return out.sort_values("id").reset_index(drop=True)


def to_spark(spark, frame):
    data = [
        (int(k), t.to_pydatetime(), int(i), None if p != p else float(p), int(v))
        for k, t, i, p, v in frame[["k", "t", "id", "p", "v"]].itertuples(index=False)
    ]
    return spark.createDataFrame(data, "k long, t timestamp_ntz, id long, p double, v long")


def run(df, hot_rows, **kw):
    out = rolling.indicators(df, "k", ["t", "id"], "p", "v", hot_rows=hot_rows, **(kw or ALL))
    return out.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("hot_rows", [HOT_ROWS, 40, 5, 1])
def test_indicators_match_pandas(spark, hot_rows):
    frame = series()
    got, want = run(to_spark(spark, frame), hot_rows), expected(frame)
    assert len(got) == len(want)
    for c in want.columns[5:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("seed", range(4))
def test_splitting_changes_nothing(spark, seed):
    df = to_spark(spark, series(seed, 150)).cache()
    whole = run(df, HOT_ROWS)
    for hot_rows in (2, 11, 30):
        pd.testing.assert_frame_equal(run(df, hot_rows), whole)


def test_blocks_stay_small(spark):
    """Every block holds about hot_rows rows plus the rows it looks back on."""
    frame = pd.DataFrame({"k": 0, "t": [DAY0 + dt.timedelta(days=i) for i in range(400)], "id": range(400), "p": 1.0, "v": 1})
    out = split_series(to_spark(spark, frame), ["k"], F.col("t"), 19, 50)
    sizes = [r["count"] for r in out.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 50 + 19
    assert out.filter("NOT _halo").count() == 400


def test_rsi_and_zero_edges(spark):
    def prices(*values):
        days = [DAY0 + dt.timedelta(days=i) for i in range(len(values))]
        return to_spark(spark, pd.DataFrame({"k": 1, "t": days, "id": range(len(values)), "p": values, "v": 0}))

    flat = run(prices(5.0, 5.0, 5.0), HOT_ROWS, rsi=(14,))
    assert flat["rsi_14"].isna().all()
    rising = run(prices(5.0, 6.0, 7.0), HOT_ROWS, rsi=(14,))
    assert rising["rsi_14"].tolist()[1:] == [100.0, 100.0]
    zero = run(prices(0.0, 3.0), HOT_ROWS, momentum=(1,), volume_ratio=(2,))
    assert zero["momentum_1d"].isna().all() and zero["volume_ratio_2"].isna().all()
    single = run(prices(4.0), HOT_ROWS, sma=(20,), volatility=(20,))
    assert single["sma_20"].tolist() == [4.0] and single["volatility_20d"].isna().all()


def test_trailing_rank(spark):
    frame = series(3, 120).dropna()
    df = to_spark(spark, frame)
    got = [rolling.trailing_rank(df, "k", ["t", "id"], "p", 6, hot_rows=h).toPandas().sort_values("id") for h in (HOT_ROWS, 4)]
    lo = frame.groupby("k")["p"].transform(lambda x: x.rolling(6, min_periods=1).min())
    hi = frame.groupby("k")["p"].transform(lambda x: x.rolling(6, min_periods=1).max())
    want = ((frame["p"] - lo) / (hi - lo).where(hi != lo)).loc[frame.sort_values("id").index]
    for g in got:
        np.testing.assert_allclose(g["trailing_rank"].astype(float), want.astype(float), rtol=1e-12)


def test_quarter_to_date_and_yoy(spark, rows):
    df = spark.createDataFrame(
        [(1, DAY0, 1, 10.0), (1, DAY0, 2, 20.0), (1, dt.datetime(2021, 4, 2), 3, 0.0), (1, dt.datetime(2021, 5, 2), 4, 5.0)],
        "k long, t timestamp_ntz, id long, p double",
    )
    out = rolling.quarter_to_date_return(df, "k", ["t", "id"], "p", F.quarter("t"))
    assert rows(out.select("id", "qtd_return")) == [(1, 0.0), (2, 1.0), (3, None), (4, None)]
    split_up = rolling.quarter_to_date_return(df, "k", ["t", "id"], "p", F.quarter("t"), hot_rows=1)
    assert rows(split_up) == rows(out)
    quarters = spark.createDataFrame([(1, 10, 4.0), (1, 13, 5.0), (1, 14, 6.0)], "k long, period long, p double")
    out = rolling.change_over(quarters, ["k"], "period", "p", 4, "yoy")
    assert rows(out.select("period", "yoy")) == [(10, None), (13, None), (14, 0.5)]


# As-of joins.


def merge(left, right, by=None):
    return pd.merge_asof(
        left.sort_values("t"), right.sort_values(["t", "rid"]), on="t", by=by, direction="backward"
    ).sort_values("id").reset_index(drop=True)


def test_asof_calendar(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"id": range(80), "t": [DAY0 + dt.timedelta(hours=int(h)) for h in rng.integers(0, 24 * 60, 80)]})
    right = pd.DataFrame({"rid": range(9), "t": [DAY0 + dt.timedelta(days=int(d)) for d in (5, 5, 11, 20, 21, 30, 30, 30, 41)], "x": np.arange(9) * 1.5})
    out = asof.asof_calendar(
        spark.createDataFrame(left), "t", spark.createDataFrame(right).withColumnRenamed("t", "rt"), "rt", ["x"], tie=["rid"]
    ).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_series_equal(out["x"], merge(left, right)["x"])
    assert out["x"].isna().any()


def test_asof_calendar_skips_null_values(spark, rows):
    left = spark.createDataFrame([(1, dt.datetime(2021, 3, 1))], "id long, t timestamp_ntz")
    right = spark.createDataFrame(
        [(dt.datetime(2021, 1, 1), 1.0), (dt.datetime(2021, 2, 1), None)], "d timestamp_ntz, x double"
    )
    assert rows(asof.asof_calendar(left, "t", right, "d", ["x"]).select("x")) == [(1.0,)]


@pytest.mark.parametrize("hot_rows", [HOT_ROWS, 60, 20, 1])
def test_asof_keyed(spark, hot_rows):
    seed = hot_rows % 7
    rng = np.random.default_rng(seed)

    def side(n, name):
        return pd.DataFrame(
            {
                "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 5, n)),
                "t": [DAY0 + dt.timedelta(hours=6 * int(h)) for h in rng.integers(0, 80, n)],
                name: range(n),
            }
        )

    left, right = side(120, "id"), side(90, "rid")
    right["x"] = rng.integers(0, 100, 90).astype(float)
    out = asof.asof_keyed(
        spark.createDataFrame(left), spark.createDataFrame(right).withColumnRenamed("t", "rt"), ["k"], "t", "rt", ["rid", "x"],
        tie=["rid"], hot_rows=hot_rows,
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = merge(left, right, "k")
    np.testing.assert_array_equal(out["rid"].astype(float), want["rid"].astype(float))
    np.testing.assert_array_equal(out["x"].astype(float), want["x"].astype(float))


def test_asof_keyed_null_keys_stay_unmatched(spark, rows):
    left = spark.createDataFrame([(None, DAY0, 1), (7, DAY0, 2)], "k long, t timestamp_ntz, id long")
    right = spark.createDataFrame([(None, DAY0, 5.0), (7, DAY0, 6.0)], "k long, rt timestamp_ntz, x double")
    assert rows(asof.asof_keyed(left, right, ["k"], "t", "rt", ["x"]).select("id", "x")) == [(1, None), (2, 6.0)]


# Calendars.


def test_calendar_keeps_empty_quarters(spark, rows):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 1),), (dt.datetime(2020, 11, 5),)], "d timestamp_ntz")
    got = [r[0].month for r in spine.quarter_calendar(df, "d").orderBy("quarter_start").collect()]
    assert got == [1, 4, 7, 10]


def test_forward_fill_and_growth(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", None), ("d", 3.0)], "q string, x double")
    filled = spine.forward_fill(df, "q", ["x"])
    assert rows(filled) == [("a", None), ("b", 2.0), ("c", 2.0), ("d", 3.0)]
    assert rows(spine.growth(filled, "q", ["x"]).select("q", "x_growth")) == [("a", None), ("b", None), ("c", 0.0), ("d", 0.5)]


def test_trailing_period(spark):
    days = [dt.datetime(2016, 3, 31), dt.datetime(2016, 4, 1), dt.datetime(2021, 4, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    assert spine.trailing_period(df, "d", 60).count() == 2


def test_dense_panel(spark, rows):
    df = spark.createDataFrame([("a", "2021Q1"), ("a", "2021Q2"), ("b", "2021Q2"), (None, "2021Q4")], "k string, q string")
    grid = spine.dense_panel(df, "k", F.col("q"))
    assert grid.count() == 2 * 3
    extra = spark.createDataFrame([("a", 1)], "k string, size int")
    assert rows(spine.dense_panel(df, "k", F.col("q"), attributes=extra).filter("quarter = '2021Q1'").select("k", "size")) == [
        ("a", 1), ("b", None),
    ]
    assert spine.dense_panel_fixed(df, ["x", "y"], "k", F.col("q")).count() == 6


def test_rows_without_an_entity_stay(spark):
    from quarterdeck.operators import rolling

    df = spark.createDataFrame(
        [("a", 1, 1.0), (None, 1, 5.0), (None, 2, 7.0), ("a", 2, 3.0)], "k string, d int, p double"
    ).selectExpr("k", "timestamp_seconds(d * 86400) AS t", "p")
    for scale in (None, 2):
        for hot in (1, 1000):
            out = rolling.indicators(df, "k", ["t"], "p", sma=(2,), momentum=(1,), rsi=(2,), scale=scale, hot_rows=hot)
            got = sorted((r["p"], r["sma_2"], r["momentum_1d"]) for r in out.collect() if r["k"])
            assert got == [(1.0, 1.0, None), (3.0, 2.0, 2.0)]
            assert sorted((r["p"], r["sma_2"], r["rsi_2"]) for r in out.collect() if not r["k"]) == [(5.0, None, None), (7.0, None, None)]
    ranked = rolling.trailing_rank(df, "k", ["t"], "p", 2).collect()
    assert sorted((r["p"], r["trailing_rank"]) for r in ranked) == [(1.0, None), (3.0, 1.0), (5.0, None), (7.0, None)]
    since = rolling.quarter_to_date_return(df, "k", ["t"], "p", F.quarter("t")).collect()
    assert sorted((r["p"], r["qtd_return"]) for r in since) == [(1.0, 0.0), (3.0, 2.0), (5.0, None), (7.0, None)]


def test_trailing_percent_rank(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, None, 5.0])] + [(None, 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double").select(
        "k", (F.lit("2021-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("i"))).alias("t"), "i", "v"
    )
    for hot in (1_000_000, 2):
        out = rolling.trailing_percent_rank(df, "k", ["t", "i"], "v", 3, hot_rows=hot).collect()
        got = {(r["k"], r["i"]): r["trailing_percent_rank"] for r in out}
        assert got == {("a", 0): None, ("a", 1): 0.0, ("a", 2): 0.5, ("a", 3): 0.5, ("a", 4): None, ("a", 5): 1.0, (None, 0): None}
