"""Daily time-series features per company."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import DAILY_MACRO
from quarterdeck.functions.keys import quarter_key
from quarterdeck.operators.asof import asof_calendar
from quarterdeck.operators.joins import label_rows, with_calendar
from quarterdeck.operators.rolling import indicators
from quarterdeck.operators.rows import known
from quarterdeck.operators.rollup import queue_depth, queue_total
from quarterdeck.operators.skew import HOT_ROWS
from quarterdeck.plans.panel import promise_events

DAILY_COLUMNS = [
    "ticker", "Date", "Close", "Volume", "sma_20", "sma_60", "volatility_20d", "momentum_20d", "rsi_14",
    "volume_ma_ratio", *DAILY_MACRO, "iso_queue_depth", "promise_label", "has_promise",
]


def daily_features(
    prices: DataFrame,
    macro: DataFrame,
    queue: DataFrame,
    promises: DataFrame,
    *,
    order: Sequence[str] = ("Date",),
    keep: Sequence[str] = (),
    ticker: Column | None = None,
    label_order: Sequence[str] = ("announcement_date",),
    hot_rows: int = HOT_ROWS,
    scale: int | None = None,
    day: Column | None = None,
) -> DataFrame:
    """Rolling indicators, macro values in force, queue depth and the quarter's promise label.

    A missing label becomes 0 in ``promise_label``; ``has_promise`` tells it
    from a broken promise. The first row of each company has no deviation and
    is dropped. ``scale`` and ``day`` are those of ``indicators``.
    """
    rolled = indicators(
        prices, "ticker", list(order), "Close", "Volume",
        sma=(20, 60), volatility=(20,), momentum=(20,), rsi=(14,), volume_ratio=(20,), hot_rows=hot_rows,
        scale=scale, day=day,
    ).withColumnRenamed("volume_ratio_20", "volume_ma_ratio")
    rolled = known(rolled, ["sma_20", "volatility_20d"])

    daily = asof_calendar(rolled, "Date", macro.select("date", *DAILY_MACRO), "date", DAILY_MACRO)
    dated = known(queue, ["Queue Date"])
    depth = queue_total(queue_depth(dated, "iso", quarter_key(F.col("Queue Date"))))
    daily = with_calendar(daily.withColumn("quarter", quarter_key(F.col("Date"))), depth)

    labels = label_rows(
        promise_events(promises, ticker), ["ticker", "quarter"], "first", label_order, "promise_kept", "promised_mw"
    ).drop("promised_mw")
    daily = daily.join(labels, ["ticker", "quarter"], "left").withColumns(
        {
            "iso_queue_depth": F.coalesce("iso_queue_depth", F.lit(0)),
            "promise_label": F.coalesce(F.col("promise_kept").cast("int"), F.lit(0)),
            "has_promise": F.col("promise_kept").isNotNull().cast("int"),
        }
    )
    return daily.select(*keep, *DAILY_COLUMNS)
