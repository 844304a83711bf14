"""Rolling indicators, returns, as-of joins and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import (
    macro,
    prices,
    promise_ticker,
    promises,
    quarter,
    queue,
    ratios,
    table,
    traded,
    units,
    with_views,
)
from quarterdeck.functions.keys import quarter_index, quarter_key
from quarterdeck.operators import asof, joins, rolling, rollup, spine
from quarterdeck.plans.daily import daily_features

ORDER = ["Date", "row_id"]
IDS = ["ticker", "Date", "row_id", "Close"]


def frame(n: int) -> str:
    return f'(PARTITION BY ticker ORDER BY "Date", row_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'


P = units('"Close"')
SMA = 'sum({p}) OVER {w}::DOUBLE / nullif(count("Close") OVER {w}::DOUBLE * 100, 0)'
SMA_20, SMA_60 = SMA.format(p=P, w=frame(20)), SMA.format(p=P, w=frame(60))
_N, _S = f'count("Close") OVER {frame(20)}', f"sum({P}) OVER {frame(20)}"
_Q = f"sum({P}::HUGEINT * {P}) OVER {frame(20)}"
VOL_20 = f"sqrt(({_N} * {_Q} - {_S} * {_S})::DOUBLE / nullif({_N}::DOUBLE * ({_N}::DOUBLE - 1), 0)) / 100"
MOM_20 = '"Close" / nullif(lag("Close", 20) OVER (PARTITION BY ticker ORDER BY "Date", row_id), 0) - 1'
DELTAS = f"""SELECT *, {P} - lag({P}) OVER (PARTITION BY ticker ORDER BY "Date", row_id) AS delta FROM base"""
GAIN = f"sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) OVER {frame(14)}::DOUBLE"
LOSS = f"sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) OVER {frame(14)}::DOUBLE"
RSI_14 = f"100.0 * {GAIN} / nullif({GAIN} + {LOSS}, 0)"
VOLUME_20 = f"""\"Volume"::DOUBLE / nullif(sum("Volume") OVER {frame(20)}::DOUBLE
    / nullif(count("Volume") OVER {frame(20)}::DOUBLE, 0), 0)"""
COLS = 'ticker, "Date", row_id, "Close"'


@query("rolling_sma", with_views("prices") + f"SELECT {COLS}, {SMA_20} AS sma_20, {SMA_60} AS sma_60 FROM prices")
def rolling_sma(spark, d):
    return rolling.indicators(prices(spark, d), "ticker", ORDER, "Close", sma=(20, 60), scale=2)


@query("rolling_vol", with_views("prices") + f"SELECT {COLS}, {VOL_20} AS volatility_20d FROM prices")
def rolling_vol(spark, d):
    return rolling.indicators(prices(spark, d), "ticker", ORDER, "Close", volatility=(20,), scale=2)


@query("momentum", with_views("prices") + f"SELECT {COLS}, {MOM_20} AS momentum_20d FROM prices")
def momentum(spark, d):
    return rolling.indicators(prices(spark, d), "ticker", ORDER, "Close", momentum=(20,), scale=2)


@query(
    "rsi",
    with_views("prices") + f", base AS (SELECT * FROM prices) SELECT {COLS}, {RSI_14} AS rsi_14 FROM ({DELTAS})",
)
def rsi(spark, d):
    return rolling.indicators(prices(spark, d), "ticker", ORDER, "Close", rsi=(14,), scale=2)


@query(
    "volume_ratio",
    with_views("prices", "traded") + f'SELECT {COLS}, "Volume", {VOLUME_20} AS volume_ratio_20 FROM traded',
)
def volume_ratio(spark, d):
    rows = traded(spark, d).select(*IDS, "Volume")
    return rolling.indicators(rows, "ticker", ORDER, "Close", "Volume", volume_ratio=(20,), scale=2)


EVENT_FRAME = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
EVENT_UNITS = units("value")


@query(
    "rolling_events",
    f"""SELECT user_id, ts, event_id, value,
    sum({EVENT_UNITS}) OVER {EVENT_FRAME}::DOUBLE / (count(value) OVER {EVENT_FRAME}::DOUBLE * 100) AS sma_20,
    value / nullif(lag(value, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1 AS momentum_5d FROM events""",
)
def rolling_events(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return rolling.indicators(rows, "user_id", ["ts", "event_id"], "value", sma=(20,), momentum=(5,), scale=2)


@query(
    "trailing_rank",
    with_views("prices")
    + f"""SELECT {COLS}, ("Close" - min("Close") OVER {frame(20)})
    / nullif(max("Close") OVER {frame(20)} - min("Close") OVER {frame(20)}, 0) AS trailing_rank FROM prices""",
)
def trailing_rank(spark, d):
    return rolling.trailing_rank(prices(spark, d), "ticker", ORDER, "Close", 20)


@query(
    "trailing_percent_rank",
    with_views("prices")
    + f"""SELECT {COLS}, len(list_filter(near, lambda v: v < "Close"))::DOUBLE / nullif(len(near) - 1, 0)
    AS trailing_percent_rank FROM (SELECT *, list("Close") OVER {frame(20)} AS near FROM prices)""",
)
def trailing_percent_rank(spark, d):
    return rolling.trailing_percent_rank(prices(spark, d), "ticker", ORDER, "Close", 20)


@query(
    "qtd_return",
    with_views("prices")
    + f"""SELECT {COLS}, "Close" / nullif(first_value("Close") OVER (PARTITION BY ticker, {quarter('"Date"')}
    ORDER BY "Date", row_id), 0) - 1 AS qtd_return FROM prices""",
)
def qtd_return(spark, d):
    return rolling.quarter_to_date_return(
        prices(spark, d), "ticker", ORDER, "Close", quarter_key(F.col("Date"))
    )


@query(
    "yoy_return",
    with_views("prices")
    + """, q AS (SELECT ticker, (year("Date") * 4 + quarter("Date") - 1)::BIGINT AS period,
    arg_max("Close", ("Date", row_id)) AS "Close" FROM prices GROUP BY ALL)
    SELECT a.ticker, a.period, a."Close", a."Close" / nullif(b."Close", 0) - 1 AS yoy_return
    FROM q a LEFT JOIN q b ON a.ticker = b.ticker AND a.period = b.period + 4""",
)
def yoy_return(spark, d):
    by_quarter = (
        prices(spark, d)
        .withColumn("period", quarter_index(F.col("Date")))
        .groupBy("ticker", "period")
        .agg(rollup.last_value("Close", F.struct(*ORDER)).alias("Close"))
    )
    return rolling.change_over(by_quarter, ["ticker"], "period", "Close", 4, "yoy_return")


@query(
    "ts_features",
    with_views("prices", "traded", "macro", "queue", "depth", "promises", "events_q", "labels_one")
    + f""", base AS (SELECT * FROM traded),
    r AS (SELECT *, {SMA_20} AS sma_20, {SMA_60} AS sma_60, {VOL_20} AS volatility_20d, {MOM_20} AS momentum_20d,
          {RSI_14} AS rsi_14, {VOLUME_20} AS volume_ma_ratio FROM ({DELTAS})),
    k AS (SELECT * FROM r WHERE sma_20 IS NOT NULL AND volatility_20d IS NOT NULL),
    m AS (SELECT date, "Fed Funds Rate", "Unemployment Rate" FROM macro
          WHERE "Fed Funds Rate" IS NOT NULL AND "Unemployment Rate" IS NOT NULL),
    t AS (SELECT quarter, sum(iso_queue_depth)::BIGINT AS iso_queue_depth FROM depth GROUP BY 1)
    SELECT k.row_id, k.ticker, k."Date", k."Close", k."Volume", sma_20, sma_60, volatility_20d, momentum_20d, rsi_14,
    volume_ma_ratio, m."Fed Funds Rate", m."Unemployment Rate", coalesce(t.iso_queue_depth, 0) AS iso_queue_depth,
    coalesce(l.promise_kept, 0) AS promise_label, (l.promise_kept IS NOT NULL)::INT AS has_promise
    FROM k ASOF LEFT JOIN m ON k."Date" >= m.date LEFT JOIN t ON t.quarter = {quarter('k."Date"')}
    LEFT JOIN labels_one l ON l.ticker = k.ticker AND l.quarter = {quarter('k."Date"')}""",
)
def ts_features(spark, d):
    return daily_features(
        traded(spark, d), macro(spark, d), queue(spark, d), promises(spark, d),
        order=ORDER, keep=["row_id"], ticker=promise_ticker(), label_order=["announcement_date", "promise_id"], scale=2,
    )


@query(
    "asof_backward",
    with_views("macro")
    + """, m AS (SELECT date, "Real GDP", "Core CPI" FROM macro WHERE "Real GDP" IS NOT NULL AND "Core CPI" IS NOT NULL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, m."Real GDP", m."Core CPI"
    FROM lineitem l ASOF LEFT JOIN m ON l.l_shipdate >= m.date""",
)
def asof_backward(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    columns = ["Real GDP", "Core CPI"]
    return asof.asof_calendar(lines, "l_shipdate", macro(spark, d).select("date", *columns), "date", columns)


@query(
    "asof_intraday",
    """SELECT e.event_id, e.ts, e.user_id, s.event_id AS signup_id, s.value AS signup_value FROM events e
    ASOF LEFT JOIN (SELECT ts, event_id, value FROM events WHERE event_type = 'signup'
                    QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1) s ON e.ts >= s.ts""",
)
def asof_intraday(spark, d):
    events = table(spark, d, "events")
    signups = events.filter("event_type = 'signup'").select(
        F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    return asof.asof_timeline(
        events.select("event_id", "ts", "user_id"), "ts", signups, "signup_ts", ["signup_id", "signup_value"], tie=["signup_id"]
    )


@query(
    "asof_keyed",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    c AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')
    SELECT p.user_id, p.ts, p.event_id, p.value, c.event_id AS click_id, c.value AS click_value
    FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def asof_keyed(spark, d):
    events = table(spark, d, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    clicks = events.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof.asof_keyed(
        bought, clicks, ["user_id"], "ts", "click_ts", ["click_id", "click_value"], tie=["click_id"]
    )


@query(
    "asof_history",
    """WITH f AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem),
    o AS (SELECT o_custkey, o_orderdate, arg_max(o_orderkey, o_orderkey) AS last_order,
          arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY ALL),
    l AS (SELECT f.*, o_custkey FROM f JOIN orders ON l_orderkey = o_orderkey)
    SELECT l.*, o.last_order, o.last_price FROM l ASOF LEFT JOIN o
    ON l.o_custkey = o.o_custkey AND l.l_shipdate >= o.o_orderdate""",
)
def asof_history(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"
    )
    owned = lines.join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).drop("o_orderkey")
    history = orders.select(
        "o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price")
    )
    return asof.asof_keyed(
        owned, history, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order", "last_price"], tie=["last_order"]
    )


@query(
    "overlay_coalesce",
    with_views("prices", "ratios")
    + """SELECT p.row_id, p.ticker, coalesce(r.profit_margin, p."Close") AS profit_margin
    FROM prices p LEFT JOIN ratios r ON p.ticker = r.ticker""",
)
def overlay_coalesce(spark, d):
    rows = prices(spark, d).select("row_id", "ticker", F.col("Close").alias("profit_margin"))
    return joins.overlay(rows, ratios(spark, d), ["ticker"], ["profit_margin"])


@query(
    "latest_per_key",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
    arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS value FROM events GROUP BY 1""",
)
def latest_per_key(spark, d):
    rows = table(spark, d, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return rollup.latest_per_key(rows, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    "latest_n_per_key",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3""",
)
def latest_n_per_key(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rollup.latest_rows(rows, "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)


@query(
    "trailing_period",
    """SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 MONTH""",
)
def trailing_period(spark, d):
    return spine.trailing_period(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 60)


COVER = """WITH f AS (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT'
    AND o_totalprice > 300000 GROUP BY 1)
    SELECT c_custkey, n_urgent FROM customer {how} JOIN f ON c_custkey = o_custkey"""


def _coverage(spark, d, policy):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    features = urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_urgent"))
    return joins.cover(table(spark, d, "customer").select("c_custkey"), features, "c_custkey", policy)


@query("entity_coverage", COVER.format(how="LEFT"))
def entity_coverage(spark, d):
    return _coverage(spark, d, "keep")


@query("entity_coverage_drop", COVER.format(how="INNER"))
def entity_coverage_drop(spark, d):
    return _coverage(spark, d, "drop")
