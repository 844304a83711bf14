"""Analyst counts and price targets for the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.exact import percent
from quarterdeck.functions.fixed_values import RECOMMENDATIONS, TARGETS
from quarterdeck.operators.fill import fill_group_median
from quarterdeck.operators.joins import with_dimension
from quarterdeck.operators.rollup import latest_per_key


def latest_recommendations(recommendations: DataFrame, order: Sequence[str] = ("period",)) -> DataFrame:
    """Newest counts per ticker."""
    return latest_per_key(recommendations, "ticker", order, RECOMMENDATIONS)


def target_premium(target: Column, current: Column, digits: int | None = 2) -> Column:
    """How far the mean target lies above the price, in percent."""
    return percent(target - current, current, digits)


def price_targets(targets: DataFrame, digits: int | None = 2) -> DataFrame:
    renamed = targets.select("ticker", *TARGETS).withColumnsRenamed(TARGETS)
    return renamed.withColumn(
        "target_premium_pct", target_premium(F.col("target_mean"), F.col("price_current"), digits)
    )


def enrich_panel(panel: DataFrame, recommendations: DataFrame, targets: DataFrame) -> DataFrame:
    """Panel with analyst columns; gaps take the ticker's median, then 0."""
    joined = with_dimension(with_dimension(panel, recommendations, "ticker"), targets, "ticker")
    # A ticker has one row per quarter, so no group is large.
    return fill_group_median(joined, "ticker", [*RECOMMENDATIONS, "target_premium_pct"], hot_rows=None)
