"""The panel in one go, for a given list of companies and with all gaps filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_mean
from quarterdeck.functions.fixed_values import MACRO_LAST, MACRO_MEAN, PANEL_TICKERS
from quarterdeck.functions.keys import present_flag, quarter_key
from quarterdeck.operators.fill import fill_two_stage, numeric_columns
from quarterdeck.operators.joins import label_rows, with_calendar, with_dimension
from quarterdeck.operators.profile import columns_with_nulls
from quarterdeck.operators.rollup import calendar_rollup, last_value
from quarterdeck.operators.rows import order_key
from quarterdeck.operators.spine import dense_panel, dense_panel_fixed
from quarterdeck.plans.panel import promise_events
from quarterdeck.session import materialize

UNFILLED = ["ticker", "quarter", "promise_kept", "promised_mw", "median_income", "median_home_value"]


def full_panel(
    prices: DataFrame,
    ratios: DataFrame,
    macro: DataFrame,
    analyst: DataFrame,
    promises: DataFrame,
    *,
    tickers: Sequence | None = PANEL_TICKERS,
    order: Sequence[str] = ("Date",),
    ticker: Column | None = None,
    label_order: Sequence[str] = ("announcement_date",),
    scale: int | None = None,
) -> DataFrame:
    """Last price and mean volume per quarter with ratios, macro, analyst and label columns.

    ``tickers`` fixes the companies; None takes those of the price table. Missing
    numbers take the company's median, then the median of the column so filled;
    label columns are left alone. The unfilled panel is written once, since the
    filling reads it several times; its companies have a row per quarter at most.
    """
    quarter = quarter_key(F.col("Date"))
    by_quarter = prices.select("*", quarter.alias("quarter")).groupBy("ticker", "quarter").agg(
        last_value("Close", order_key(order)).alias("Close"),
        exact_mean(F.col("Volume"), None if scale is None else 0).alias("Volume"),
    )
    # Ratios belong to a quarter the company traded in, as do its prices.
    by_quarter = with_dimension(by_quarter, ratios, "ticker")
    indicators = [c for c in [*MACRO_LAST, *MACRO_MEAN] if c in macro.columns]
    macro_q = calendar_rollup(macro, quarter_key(F.col("date")), "date", last=indicators)

    if tickers is None:
        spine = dense_panel(prices, "ticker", quarter)
    else:
        spine = dense_panel_fixed(prices, tickers, "ticker", quarter)
    extras = [c for c in ("median_income", "median_home_value") if c in promises.columns]
    labels = label_rows(
        promise_events(promises, ticker), ["ticker", "quarter"], "total", label_order,
        "promise_kept", "promised_mw", extras, scale,
    )
    panel = spine.join(by_quarter, ["ticker", "quarter"], "left").join(labels, ["ticker", "quarter"], "left")
    panel = with_dimension(with_calendar(panel, macro_q), analyst, "ticker")
    panel = panel.withColumn("has_promise", present_flag(F.col("promise_kept")))
    panel = materialize(panel)
    gaps = columns_with_nulls(panel, numeric_columns(panel, [*UNFILLED, "has_promise"]))
    return fill_two_stage(panel, "ticker", gaps, scale, hot_rows=None) if gaps else panel
