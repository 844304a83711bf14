"""Dense grids and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.keys import quarter_start
from quarterdeck.operators.rows import known


def periods_present(df: DataFrame, period: Column) -> Column:
    """The distinct periods of a table as one sorted array, read as a scalar subquery.

    The array is bounded by the calendar (four entries per year).
    """
    return df.select(period.alias("_p")).agg(F.sort_array(F.collect_set("_p"))).scalar()


def dense_panel(
    df: DataFrame, entity: str, period: Column, out: str = "quarter", attributes: DataFrame | None = None
) -> DataFrame:
    """Every entity of the table beside every period of the table.

    Each entity row is unfolded over the array of periods, so there is no cross
    join and the only shuffle is the one that makes the entities distinct.
    ``attributes``, one row per entity, are joined before the unfolding, while
    there is still a single row per entity.
    """
    entities = known(df.select(entity), [entity]).distinct()
    if attributes is not None:
        entities = entities.join(attributes, entity, "left")
    return entities.select("*", F.explode(periods_present(df, period)).alias(out))


def dense_panel_fixed(
    df: DataFrame, entities: Sequence, entity: str, period: Column, out: str = "quarter"
) -> DataFrame:
    """As ``dense_panel``, for a given list of entities."""
    names = df.sparkSession.createDataFrame([(e,) for e in entities], [entity])
    return names.select(entity, F.explode(periods_present(df, period)).alias(out))


def quarter_calendar(df: DataFrame, ts: str, out: str = "quarter_start") -> DataFrame:
    """All quarter starts from the table's first to its last quarter, gaps included."""
    ends = df.agg(quarter_start(F.min(ts)).alias("_lo"), quarter_start(F.max(ts)).alias("_hi"))
    return ends.select(
        F.explode(F.sequence("_lo", "_hi", F.expr("interval 3 month"))).alias(out)
    )


def forward_fill(calendar: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Carry the last non-null value of each column down a calendar table.

    For tables already reduced to one row per period. Their length is bounded
    by the calendar, which is why an unpartitioned window is fine here.
    """
    down = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return calendar.withColumns({c: F.last(c, ignorenulls=True).over(down) for c in columns})


def growth(calendar: DataFrame, order: str, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """Relative change of each column against ``lag`` rows earlier in a calendar table."""
    down = W.orderBy(order)
    return calendar.withColumns(
        {
            f"{c}_growth": F.col(c) / F.nullif(F.lag(c, lag).over(down), F.lit(0.0)) - F.lit(1.0)
            for c in columns
        }
    )


def trailing_period(df: DataFrame, ts: str, months: int) -> DataFrame:
    """Rows of the last ``months`` months, counted back from the newest row."""
    newest = df.agg(F.max(ts)).scalar()
    start = newest.cast("timestamp_ntz") - F.make_ym_interval(F.lit(0), F.lit(months))
    return df.filter(F.col(ts) >= start)
