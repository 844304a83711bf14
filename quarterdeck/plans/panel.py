"""Company by quarter panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import (
    MACRO_LAST,
    MACRO_MEAN,
    QUEUE_REGIONS,
    RATIO_COLUMNS,
    TICKER_MAP,
)
from quarterdeck.functions.keys import quarter_key, recode
from quarterdeck.operators.fill import fill_zero
from quarterdeck.operators.joins import attach_labels, label_rows, with_calendar
from quarterdeck.operators.rollup import calendar_rollup, price_rollup, queue_depth, queue_wide
from quarterdeck.operators.spine import dense_panel, forward_fill
from quarterdeck.sources.files import pick

PRICE_FEATURES = [
    "q_avg_close", "q_volatility", "q_min_close", "q_max_close", "q_avg_volume", "q_total_volume",
    "q_avg_open", "q_avg_high", "q_avg_low",
]


def macro_quarters(macro: DataFrame, scale: int | None = None) -> DataFrame:
    """One row per quarter: last level of output and prices, mean of the rates, gaps filled forward."""
    means = {c: scale for c in MACRO_MEAN if c in macro.columns}
    lasts = [c for c in MACRO_LAST if c in macro.columns]
    by_quarter = calendar_rollup(macro, quarter_key(F.col("date")), "date", lasts, means)
    return forward_fill(by_quarter, "quarter", [*lasts, *means])


def promise_events(promises: DataFrame, ticker: Column | None = None) -> DataFrame:
    """Promises keyed by ticker and target quarter; without a date they have no quarter."""
    code = ticker if ticker is not None else recode(F.col("company_ticker"), TICKER_MAP)
    return promises.withColumns({"ticker": code, "quarter": quarter_key(F.col("target_date"))})


def quarterly_panel(
    prices: DataFrame,
    ratios: DataFrame,
    macro: DataFrame,
    queue: DataFrame,
    promises: DataFrame,
    *,
    ticker: Column | None = None,
    regions: Sequence[str] = QUEUE_REGIONS,
    policy: str = "total",
    label_order: Sequence[str] = ("announcement_date",),
    zero_fill: bool = False,
    scale: int | None = None,
    pending: bool = False,
) -> DataFrame:
    """Every company beside every quarter, with price, ratio, macro and queue features and labels.

    ``policy`` says what several promises of one company and quarter become
    (see ``label_rows``, also for ``pending``). Queue columns are 0 without a project; ``zero_fill``
    also zeroes every other missing number except the label. ``scale`` declares
    the decimals of prices, rates and amounts, volumes being whole; sums are then exact.
    """
    quarter = quarter_key(F.col("Date"))
    means = {c: f"q_avg_{c.lower()}" for c in ("Open", "High", "Low") if c in prices.columns}
    features = price_rollup(
        prices.select("*", quarter.alias("quarter")), ["ticker", "quarter"], "Close", "Volume", means,
        scale, None if scale is None else 0,
    )
    wide = queue_wide(queue_depth(queue, "iso", quarter_key(F.col("Queue Date"))), regions)
    queue_columns = [c for c in wide.columns if c != "quarter"]

    labels = label_rows(
        promise_events(promises, ticker), ["ticker", "quarter"], policy, label_order, "promise_kept", "promised_mw",
        scale=scale, pending=pending,
    )

    # Both joins on company and quarter come first: they share one partitioning.
    spine = dense_panel(prices, "ticker", quarter, attributes=pick(ratios, ["ticker", *RATIO_COLUMNS]))
    panel = spine.join(features, ["ticker", "quarter"], "left")
    panel = attach_labels(panel, labels, ["ticker", "quarter"], "promise_kept", "promised_mw")
    panel = with_calendar(with_calendar(panel, macro_quarters(macro, scale)), wide)
    unfilled = ["ticker", "promise_kept", "promised_mw", "has_promise"]
    panel = fill_zero(panel, None if zero_fill else queue_columns, exclude=unfilled)
    return pick(
        panel,
        ["ticker", "quarter", *PRICE_FEATURES, *RATIO_COLUMNS, *MACRO_LAST, *MACRO_MEAN, *queue_columns,
         "promise_kept", "promised_mw", "has_promise"],
    )
