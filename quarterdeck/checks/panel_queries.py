"""Spines, roll-ups, dimension joins, labels and the panel itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import (
    REGIONS,
    macro,
    mean,
    prices,
    promise_ticker,
    promises,
    quarter,
    queue,
    ratios,
    table,
    total,
    traded,
    units,
    with_views,
)
from quarterdeck.functions.keys import quarter_key, quarter_start
from quarterdeck.functions.fixed_values import RECOMMENDATIONS
from quarterdeck.operators import joins, rollup, spine
from quarterdeck.plans.analyst import enrich_panel, latest_recommendations, price_targets
from quarterdeck.plans.panel import macro_quarters, promise_events, quarterly_panel
from quarterdeck.plans.promises import promise_matrix
from quarterdeck.plans.rebuild import full_panel

KEYS = ["ticker", "quarter"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDER = ["announcement_date", "promise_id"]
MACRO = ["Real GDP", "Core CPI", "Fed Funds Rate", "Unemployment Rate", "30Y Mortgage Rate", "10Y Treasury"]


def _quarter(col="Date"):
    return quarter_key(F.col(col))


@query("panel_spine", with_views("prices", "spine") + "SELECT * FROM spine")
def panel_spine(spark, d):
    return spine.dense_panel(prices(spark, d), "ticker", _quarter())


@query(
    "panel_spine_fixed",
    with_views("prices")
    + f"""SELECT t.ticker, q.quarter FROM (SELECT unnest([1, 2, 3, 5, 8]) AS ticker) t,
    (SELECT DISTINCT {quarter('"Date"')} AS quarter FROM prices) q""",
)
def panel_spine_fixed(spark, d):
    grid = spine.dense_panel_fixed(prices(spark, d), [1, 2, 3, 5, 8], "ticker", _quarter())
    return grid.withColumn("ticker", F.col("ticker").cast("int"))


@query("fin_quarter", with_views("prices", "traded", "fin") + "SELECT * FROM fin")
def fin_quarter(spark, d):
    rows = traded(spark, d).withColumn("quarter", _quarter())
    means = {"Open": "q_avg_open", "High": "q_avg_high", "Low": "q_avg_low"}
    return rollup.price_rollup(rows, KEYS, "Close", "Volume", means, 2, 0)


@query(
    "fin_quarter_mean",
    with_views("prices", "traded")
    + f"""SELECT ticker, {quarter('"Date"')} AS quarter, {mean('"Close"')} AS q_close, {mean('"Volume"')} AS q_volume
    FROM traded GROUP BY ALL""",
)
def fin_quarter_mean(spark, d):
    rows = traded(spark, d).withColumn("quarter", _quarter())
    return rollup.mean_rollup(rows, KEYS, ["Close", "Volume", "market_cap", "revenue", "ebitda"], scale=2)


@query(
    "static_dim",
    with_views("prices", "ratios")
    + """SELECT p.row_id, p.ticker, p."Close", r.market_cap, r.profit_margin, r.beta
    FROM prices p LEFT JOIN ratios r ON p.ticker = r.ticker""",
)
def static_dim(spark, d):
    rows = prices(spark, d).select("row_id", "ticker", "Close")
    return joins.with_dimension(rows, ratios(spark, d), "ticker")


@query(
    "calendar_dim",
    with_views("prices", "macro", "macro_q")
    + f"""SELECT p.row_id, {quarter('p."Date"')} AS quarter, m."Real GDP", m."Fed Funds Rate"
    FROM prices p LEFT JOIN macro_q m ON m.quarter = {quarter('p."Date"')}""",
)
def calendar_dim(spark, d):
    lasts, means = MACRO[:2], {c: 2 for c in MACRO[2:]}
    calendar = rollup.calendar_rollup(macro(spark, d), _quarter("date"), "date", lasts, means)
    rows = prices(spark, d).select("row_id", _quarter().alias("quarter"))
    return joins.with_calendar(rows, calendar.select("quarter", "Real GDP", "Fed Funds Rate"))


LABELLED = """SELECT s.ticker, s.quarter, l.promise_kept, coalesce(l.promised_mw, 0) AS promised_mw,
    (l.promise_kept IS NOT NULL)::INT AS has_promise FROM spine s LEFT JOIN {rows} l
    ON s.ticker = l.ticker AND s.quarter = l.quarter"""


def _labelled(spark, d, policy):
    grid = spine.dense_panel(prices(spark, d), "ticker", _quarter())
    events = promise_events(promises(spark, d), promise_ticker())
    rows = joins.label_rows(events, KEYS, policy, ORDER, "promise_kept", "promised_mw", scale=2)
    return joins.attach_labels(grid, rows, KEYS, "promise_kept", "promised_mw")


@query(
    "labels_fanout",
    with_views("prices", "spine", "promises", "events_q") + LABELLED.format(rows="events_q"),
)
def labels_fanout(spark, d):
    return _labelled(spark, d, "fanout")


@query(
    "labels_first",
    with_views("prices", "spine", "promises", "events_q", "labels_one") + LABELLED.format(rows="labels_one"),
)
def labels_first(spark, d):
    return _labelled(spark, d, "first")


@query(
    "panel_labels",
    with_views("prices", "spine", "promises", "events_q", "labels_total") + LABELLED.format(rows="labels_total"),
)
def panel_labels(spark, d):
    return _labelled(spark, d, "total")


@query(
    "labels_agg",
    with_views("promises", "events_q", "labels_total") + "SELECT * FROM labels_total",
)
def labels_agg(spark, d):
    events = promise_events(promises(spark, d), promise_ticker())
    return joins.label_rows(events, KEYS, "total", ORDER, "promise_kept", "promised_mw", scale=2)


@query(
    "labels_pending",
    with_views("promises", "events_q")
    + f"""SELECT ticker, quarter, arg_min(promise_kept, (announcement_date, promise_id))
    FILTER (WHERE promise_kept IS NOT NULL) AS promise_kept, {total('promised_mw')} AS promised_mw
    FROM events_q WHERE ticker IS NOT NULL AND quarter IS NOT NULL GROUP BY ALL""",
)
def labels_pending(spark, d):
    """Amounts of promises that are still open count as well."""
    events = promise_events(promises(spark, d), promise_ticker())
    return joins.label_rows(events, KEYS, "total", ORDER, "promise_kept", "promised_mw", scale=2, pending=True)


@query(
    "labeled_only",
    with_views("prices", "spine", "promises", "events_q", "labels_total")
    + f"SELECT * FROM ({LABELLED.format(rows='labels_total')}) WHERE has_promise = 1",
)
def labeled_only(spark, d):
    return _labelled(spark, d, "total").filter(F.col("has_promise") == 1)


@query(
    "unmatched_labels",
    with_views("prices", "spine", "promises", "events_q")
    + """SELECT promise_id, ticker, quarter FROM events_q e
    WHERE NOT EXISTS (SELECT 1 FROM spine s WHERE s.ticker = e.ticker AND s.quarter = e.quarter)""",
)
def unmatched_labels(spark, d):
    events = promise_events(promises(spark, d), promise_ticker()).select("promise_id", *KEYS)
    return joins.unmatched(events, spine.dense_panel(prices(spark, d), "ticker", _quarter()), KEYS)


MACRO_LIST = ", ".join(f'"{c}"' for c in MACRO)


@query("macro_quarter", with_views("macro", "macro_q") + f"SELECT quarter, {MACRO_LIST} FROM macro_q")
def macro_quarter(spark, d):
    means = {c: 2 for c in MACRO[2:]}
    return rollup.calendar_rollup(macro(spark, d), _quarter("date"), "date", MACRO[:2], means)


@query("ffill_calendar", with_views("macro", "macro_q", "macro_f") + f"SELECT quarter, {MACRO_LIST} FROM macro_f")
def ffill_calendar(spark, d):
    return macro_quarters(macro(spark, d), 2)


@query(
    "growth_rate",
    with_views("macro", "macro_q", "macro_f")
    + f"""SELECT quarter, {MACRO_LIST},
    "Real GDP" / nullif(lag("Real GDP") OVER (ORDER BY quarter), 0) - 1 AS "Real GDP_growth",
    "Core CPI" / nullif(lag("Core CPI") OVER (ORDER BY quarter), 0) - 1 AS "Core CPI_growth" FROM macro_f""",
)
def growth_rate(spark, d):
    return spine.growth(macro_quarters(macro(spark, d), 2), "quarter", MACRO[:2])


LAST_OF_QUARTER = ", ".join(f'arg_max("{c}", date) FILTER (WHERE "{c}" IS NOT NULL) AS "{c}"' for c in MACRO)
DENSE = f"""SELECT q.quarter_start, {MACRO_LIST} FROM
    (SELECT unnest(generate_series(date_trunc('quarter', min(date)), date_trunc('quarter', max(date)),
            INTERVAL 3 MONTH))::TIMESTAMP AS quarter_start FROM macro) q
    LEFT JOIN (SELECT date_trunc('quarter', date)::TIMESTAMP AS quarter_start, {LAST_OF_QUARTER} FROM macro GROUP BY 1) m
    ON q.quarter_start = m.quarter_start"""


@query("resample_last", with_views("macro") + DENSE)
def resample_last(spark, d):
    rows = macro(spark, d)
    calendar = spine.quarter_calendar(rows, "date")
    return rollup.resample_last(rows, calendar, quarter_start(F.col("date")), "date", MACRO, "quarter_start")


@query(
    "promise_macro",
    with_views("promises", "macro")
    + f"""SELECT p.promise_id, {quarter('p.announcement_date')} AS announcement_quarter, {MACRO_LIST}
    FROM promises p LEFT JOIN ({DENSE}) m ON {quarter('m.quarter_start')} = {quarter('p.announcement_date')}""",
)
def promise_macro(spark, d):
    rows = macro(spark, d)
    dense = rollup.resample_last(
        rows, spine.quarter_calendar(rows, "date"), quarter_start(F.col("date")), "date", MACRO, "quarter_start"
    ).select(_quarter("quarter_start").alias("quarter"), *MACRO)
    events = promises(spark, d).select("promise_id", _quarter("announcement_date").alias("announcement_quarter"))
    # One row per quarter.
    return joins.lookup(events, F.broadcast(dense), {"announcement_quarter": "quarter"})


@query("queue_depth", with_views("queue", "depth") + "SELECT * FROM depth")
def queue_depth(spark, d):
    return rollup.queue_depth(queue(spark, d), "iso", _quarter("Queue Date"))


@query(
    "queue_total",
    with_views("queue", "depth")
    + "SELECT quarter, sum(iso_queue_depth)::BIGINT AS iso_queue_depth FROM depth GROUP BY 1",
)
def queue_total(spark, d):
    return rollup.queue_total(rollup.queue_depth(queue(spark, d), "iso", _quarter("Queue Date")))


@query("pivot_queue", with_views("queue", "depth", "wide") + "SELECT * FROM wide")
def pivot_queue(spark, d):
    return rollup.queue_wide(rollup.queue_depth(queue(spark, d), "iso", _quarter("Queue Date")), REGIONS)


PANEL_VIEWS = (
    "prices", "traded", "macro", "queue", "promises", "ratios", "fin", "spine", "macro_q", "macro_f", "depth",
    "wide", "events_q", "labels_total",
)


@query(
    "panel",
    with_views(*PANEL_VIEWS)
    + f"""SELECT s.ticker, s.quarter, q_avg_close, q_volatility, q_min_close, q_max_close, q_avg_volume,
    q_total_volume, q_avg_open, q_avg_high, q_avg_low, market_cap, profit_margin, beta, {MACRO_LIST},
    coalesce(queue_A, 0) AS "queue_A", coalesce(queue_N, 0) AS "queue_N", coalesce(queue_R, 0) AS "queue_R",
    promise_kept, coalesce(promised_mw, 0) AS promised_mw, (promise_kept IS NOT NULL)::INT AS has_promise
    FROM spine s LEFT JOIN fin f ON s.ticker = f.ticker AND s.quarter = f.quarter
    LEFT JOIN ratios r ON s.ticker = r.ticker LEFT JOIN macro_f m ON s.quarter = m.quarter
    LEFT JOIN wide w ON s.quarter = w.quarter
    LEFT JOIN labels_total l ON s.ticker = l.ticker AND s.quarter = l.quarter""",
)
def panel(spark, d):
    return quarterly_panel(
        traded(spark, d), ratios(spark, d), macro(spark, d), queue(spark, d), promises(spark, d),
        ticker=promise_ticker(), regions=REGIONS, label_order=ORDER, scale=2,
    )


@query(
    "promise_matrix",
    with_views("prices", "traded", "macro", "queue", "promises", "ratios", "depth")
    + f"""SELECT p.promise_id, p.company_ticker, p.company_tier, p.iso, p.announcement_date, p.target_date,
    p.promised_mw, p.promise_kept, p.ticker AS ticker_clean, {quarter('p.announcement_date')} AS announcement_quarter,
    {MACRO_LIST}, q_close, q_volume, profit_margin, coalesce(iso_queue_depth, 0) AS iso_queue_depth
    FROM promises p LEFT JOIN ({DENSE}) m ON {quarter('m.quarter_start')} = {quarter('p.announcement_date')}
    LEFT JOIN (SELECT ticker, {quarter('"Date"')} AS quarter, {mean('"Close"')} AS q_close,
               {mean('"Volume"')} AS q_volume FROM traded GROUP BY ALL) c
      ON c.ticker = p.ticker AND c.quarter = {quarter('p.announcement_date')}
    LEFT JOIN ratios r ON r.ticker = p.ticker
    LEFT JOIN depth d ON d.iso = upper(p.iso) AND d.quarter = {quarter('p.announcement_date')}""",
)
def promise_features(spark, d):
    return promise_matrix(
        promises(spark, d), traded(spark, d), ratios(spark, d), macro(spark, d), queue(spark, d),
        ticker=promise_ticker(), scale=2,
    )


LATEST = ", ".join(
    f"""arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority = '{p}') AS "{c}" """
    for c, p in zip(RECOMMENDATIONS, PRIORITIES)
)


@query(
    "panel_analyst",
    with_views("prices", "spine")
    + f""", recs AS (SELECT o_custkey AS ticker, {LATEST} FROM orders GROUP BY 1),
    targets AS (SELECT c_custkey AS ticker, c_acctbal AS price_current, c_acctbal + 2 AS target_high,
      c_acctbal - 2 AS target_low, c_acctbal + 1 AS target_mean, c_acctbal AS target_median,
      100 * ((c_acctbal + 1 - c_acctbal) / nullif(c_acctbal, 0)) AS premium FROM customer)
    SELECT s.ticker, s.quarter, {", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in RECOMMENDATIONS)},
    price_current, target_high, target_low, target_mean, target_median, coalesce(premium, 0) AS target_premium_pct
    FROM spine s LEFT JOIN recs r ON s.ticker = r.ticker LEFT JOIN targets t ON s.ticker = t.ticker""",
)
def panel_analyst(spark, d):
    counts = {
        c: F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")) for c, p in zip(RECOMMENDATIONS, PRIORITIES)
    }
    recs = table(spark, d, "orders").withColumns(counts).withColumnRenamed("o_custkey", "ticker")
    balance = F.col("c_acctbal")
    targets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("ticker"), balance.alias("current"), (balance + 2).alias("high"),
        (balance - 2).alias("low"), (balance + 1).alias("mean"), balance.alias("median"),
    )
    grid = spine.dense_panel(prices(spark, d), "ticker", _quarter())
    latest = latest_recommendations(recs, ["o_orderdate", "o_orderkey"])
    return enrich_panel(grid, latest, price_targets(targets, digits=None))


def _two_stage(columns):
    group = ", ".join(
        f"""coalesce("{c}", median({units(f'"{c}"', 4)}) OVER (PARTITION BY ticker) / 10000) AS "{c}" """ for c in columns
    )
    final = ", ".join(
        f"""coalesce("{c}", (SELECT median({units(f'"{c}"', 5)}) / 100000 FROM g)) AS "{c}" """ for c in columns
    )
    return group, final


REBUILT = ["Close", "Volume", "market_cap", "profit_margin", *MACRO, "strongBuy", "buy"]
_GROUP, _FINAL = _two_stage(REBUILT)


@query(
    "panel_rebuild",
    with_views("prices", "traded", "macro", "promises", "ratios", "spine", "events_q", "labels_total")
    + f""", fin2 AS (SELECT ticker, {quarter('"Date"')} AS quarter,
      arg_max("Close", ("Date", row_id)) AS "Close", sum("Volume")::DOUBLE / count("Volume") AS "Volume"
      FROM traded GROUP BY ALL),
    fin3 AS (SELECT f.*, market_cap, profit_margin FROM fin2 f LEFT JOIN ratios r ON f.ticker = r.ticker),
    macro_l AS (SELECT {quarter('date')} AS quarter, {LAST_OF_QUARTER} FROM macro GROUP BY 1),
    analyst AS (SELECT c_custkey AS ticker, c_nationkey::DOUBLE AS "strongBuy",
      CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS buy FROM customer),
    p AS (SELECT s.ticker, s.quarter, f."Close", f."Volume", f.market_cap, f.profit_margin, {MACRO_LIST}, a."strongBuy", a.buy,
      l.promise_kept, l.promised_mw,
      (l.promise_kept IS NOT NULL)::INT AS has_promise
      FROM spine s LEFT JOIN fin3 f ON s.ticker = f.ticker AND s.quarter = f.quarter
      LEFT JOIN macro_l m ON s.quarter = m.quarter LEFT JOIN analyst a ON s.ticker = a.ticker
      LEFT JOIN labels_total l ON s.ticker = l.ticker AND s.quarter = l.quarter),
    g AS (SELECT ticker, quarter, {_GROUP}, promise_kept, promised_mw, has_promise FROM p)
    SELECT ticker, quarter, {_FINAL}, promise_kept, promised_mw, has_promise FROM g""",
)
def panel_rebuild(spark, d):
    analyst = table(spark, d, "customer").select(
        F.col("c_custkey").alias("ticker"),
        F.col("c_nationkey").cast("double").alias("strongBuy"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("buy"),
    )
    margins = ratios(spark, d).select("ticker", "market_cap", "profit_margin")
    return full_panel(
        traded(spark, d), margins, macro(spark, d), analyst, promises(spark, d),
        tickers=None, order=["Date", "row_id"], ticker=promise_ticker(), label_order=ORDER, scale=4,
    )
