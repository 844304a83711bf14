"""Promise-centred feature matrix: one row per promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import (
    GRID_REGIONS,
    PROMISE_RATIOS,
    TICKER_PREFIX,
    TIER_BOUNDS,
    TIERS,
)
from quarterdeck.functions.keys import (
    bucket,
    days_apart,
    fiscal_quarter,
    in_season,
    months_apart,
    quarter_key,
    quarter_start,
    repair_shift,
    strip_prefix,
)
from quarterdeck.operators.joins import lookup
from quarterdeck.operators.rollup import mean_rollup, queue_depth, resample_last
from quarterdeck.operators.spine import quarter_calendar
from quarterdeck.operators.split import one_hot
from quarterdeck.sources.files import pick

COMPANY_MEANS = ["Close", "Volume", "market_cap", "revenue", "ebitda"]


def clean_ticker(promises: DataFrame) -> Column:
    """Ticker without its prefix, taken from the next column on rows that are shifted by one."""
    code = strip_prefix(F.col("company_ticker"), TICKER_PREFIX)
    return repair_shift(code, strip_prefix(F.col("company_tier"), TICKER_PREFIX), GRID_REGIONS)


def company_tier(market_cap: Column) -> Column:
    """Tier of a company by its market value in dollars."""
    return bucket(market_cap, TIER_BOUNDS, TIERS[-1])


def tier_columns(df: DataFrame, column: str = "company_tier") -> DataFrame:
    """A 0/1 column per tier."""
    return one_hot(df, column, TIERS, prefix="")


def with_timing(promises: DataFrame) -> DataFrame:
    """When a promise was announced and how long it ran to its target."""
    start, end = F.col("announcement_date"), F.col("target_date")
    return promises.withColumns(
        {
            "announced_quarter": F.quarter(start),
            "announced_month": F.month(start),
            "announced_weekday": F.dayofweek(start),
            "days_to_target": days_apart(start, end),
            "months_to_target": months_apart(start, end),
            "in_season": in_season(start),
            "fiscal_quarter": fiscal_quarter(start),
        }
    )


def promise_matrix(
    promises: DataFrame,
    prices: DataFrame,
    ratios: DataFrame,
    macro: DataFrame,
    queue: DataFrame,
    *,
    ticker: Column | None = None,
    macro_columns: Sequence[str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Promises with macro values, company means, ratios and queue depth of their announcement quarter."""
    macro_columns = list(macro_columns or [c for c in macro.columns if c != "date"])
    base = promises.withColumns(
        {
            "ticker_clean": ticker if ticker is not None else clean_ticker(promises),
            "announcement_quarter": quarter_key(F.col("announcement_date")),
        }
    )
    by_quarter = resample_last(
        macro, quarter_calendar(macro, "date"), quarter_start(F.col("date")), "date", macro_columns, "quarter_start"
    ).select(quarter_key(F.col("quarter_start")).alias("quarter"), *macro_columns)
    # One row per quarter.
    out = lookup(base, F.broadcast(by_quarter), {"announcement_quarter": "quarter"})

    company = mean_rollup(
        prices.select("*", quarter_key(F.col("Date")).alias("quarter")), ["ticker", "quarter"], COMPANY_MEANS,
        scale=scale,
    )
    out = lookup(out, company, {"ticker_clean": "ticker", "announcement_quarter": "quarter"})
    out = lookup(out, pick(ratios, ["ticker", *PROMISE_RATIOS]), {"ticker_clean": "ticker"})
    depth = queue_depth(queue, "iso", quarter_key(F.col("Queue Date")))
    out = out.withColumn("_iso", F.upper("iso"))
    out = lookup(out, depth, {"_iso": "iso", "announcement_quarter": "quarter"}).drop("_iso")
    return out.withColumn("iso_queue_depth", F.coalesce("iso_queue_depth", F.lit(0)))
