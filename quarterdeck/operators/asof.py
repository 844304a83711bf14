"""As-of joins: the latest right row at or before each left row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.keys import day_start
from quarterdeck.operators.ranges import CELL, carried, in_cells
from quarterdeck.operators.rows import known, order_key
from quarterdeck.operators.skew import HOT_ROWS, hot_groups


def asof_calendar(
    left: DataFrame,
    left_ts: str,
    right: DataFrame,
    right_ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """As-of join without entity keys, for a right side dated by the day.

    The right side is reduced to its last row per day (later ``tie`` wins) and
    unfolded so that every calendar day up to the last one has the row then in
    force. That table has one row per day at most, so it is broadcast and the
    left side is neither shuffled nor sorted. Left rows beyond the last day
    look up that day; those without a date find nothing. A right row counts for
    its whole day; where its time of day matters, use ``asof_timeline``.
    """
    newest = order_key([right_ts, *tie])
    daily = (
        known(right, [right_ts, *columns])
        .groupBy(day_start(F.col(right_ts)).alias("_day"))
        .agg(*[F.max_by(c, newest).alias(c) for c in columns])
    )
    one_day = F.expr("interval 1 day")
    until = F.coalesce(F.lead("_day").over(W.orderBy("_day")) - one_day, F.col("_day"))
    in_force = daily.withColumn("_until", until).select(
        F.explode(F.sequence("_day", "_until", one_day)).alias("_at"), *columns
    )
    last_day = daily.agg(F.max("_day")).scalar()
    keyed = left.withColumn("_at", F.when(F.col(left_ts).isNotNull(), F.least(day_start(F.col(left_ts)), last_day)))
    return keyed.join(F.broadcast(in_force), "_at", "left").drop("_at")


def asof_timeline(
    left: DataFrame,
    left_ts: str,
    right: DataFrame,
    right_ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """As-of join without entity keys, exact to the instant, both sides of any size.

    Both sides are first reduced to a row per instant: the right side to the row with the highest ``tie``
    among those without a null in ``columns``, the left side to the instants it asks for. That timeline is cut
    into cells of about equal size, a window looks back inside each, and an instant with nothing before it in
    its cell takes what the earlier cells closed with. The left side then looks up its instants with an
    equi-join, which Spark splits where one instant has very many rows. No calendar is unfolded and nothing is broadcast by a hint.

    A right row at the same instant counts. Left rows without a time, or before the first right row, find nothing.
    """
    usable = known(right, [right_ts, *columns])
    best = F.max(F.struct(*[F.struct(*tie).alias("tie")] if tie else [], F.struct(*columns).alias("match")))
    # Of equal ties the greatest values win, so that the result does not depend on the order of rows.
    matches = usable.groupBy(F.col(right_ts).alias("_t")).agg(best["match"].alias("_match"))
    asked = known(left, [left_ts]).select(F.col(left_ts).alias("_t")).distinct()
    instants = matches.unionByName(asked, allowMissingColumns=True).groupBy("_t").agg(F.max("_match").alias("_match"))
    cells = in_cells(instants, ["_t"])
    so_far = W.partitionBy(CELL).orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    opening = carried(cells, "_match", F.col("_t"), "_opening")
    found = cells.withColumn("_found", F.last("_match", ignorenulls=True).over(so_far)).join(opening, CELL)
    found = found.select(F.col("_t").alias("_at"), F.coalesce("_found", "_opening").alias("_found"))
    return left.join(found, F.col(left_ts) == F.col("_at"), "left").select(*[left[c] for c in left.columns], "_found.*")


def _latest_match(rows: DataFrame, matches: DataFrame, within: Sequence[str]) -> DataFrame:
    """For each left row the latest right row at or before it inside the given partition."""
    both = rows.withColumn("_side", F.lit(1)).unionByName(
        matches.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    so_far = W.partitionBy(*within).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_match", ignorenulls=True).over(so_far)).filter("_side = 1")


def _latest_match_by_cell(rows: DataFrame, matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """As ``_latest_match``, spread over (entity, day) cells.

    Inside a cell the window sees only the rows of one day. A left row with no
    match there takes the last right row of the entity's earlier days, from a
    table with one row per cell.
    """
    closing = matches.groupBy(*by, "_cell").agg(F.max_by("_match", F.struct("_t", "_tie")).alias("_closing"))
    left_cells = rows.select(*by, "_cell").distinct()
    earlier = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    opening = left_cells.join(closing, [*by, "_cell"], "full").select(
        *by, "_cell", F.last("_closing", ignorenulls=True).over(earlier).alias("_opening")
    )
    found = _latest_match(rows, matches, [*by, "_cell"])
    return found.join(opening, [*by, "_cell"], "left").withColumn("_found", F.coalesce("_found", "_opening"))


def asof_keyed(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    cell: Callable[[Column], Column] = day_start,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As-of join within entities, both sides of any size.

    A right row at the same instant counts, and of several the one with the
    highest ``tie`` wins. Ordinary entities take one shuffle and one window over
    both sides. Entities with more than ``hot_rows`` rows are spread over their
    days (or a finer ``cell``). Rows without a key or a time have no match.
    """
    by = list(by)
    needed = [*by, left_ts]
    complete = known(left, needed)
    rows = complete.select(
        *by,
        F.col(left_ts).alias("_t"),
        cell(F.col(left_ts)).alias("_cell"),
        F.struct(*left.columns).alias("_left"),
    )
    matches = known(right, [*by, right_ts]).select(
        *by,
        F.col(right_ts).alias("_t"),
        cell(F.col(right_ts)).alias("_cell"),
        F.struct(*tie, F.lit(0).alias("_none")).alias("_tie"),
        F.struct(*columns).alias("_match"),
    )
    hot = F.broadcast(hot_groups(rows.select(*by).unionByName(matches.select(*by)), by, hot_rows))
    ordinary = _latest_match(rows.join(hot, by, "left_anti"), matches.join(hot, by, "left_anti"), by)
    large = _latest_match_by_cell(rows.join(hot, by, "left_semi"), matches.join(hot, by, "left_semi"), by)
    found = ordinary.select("_left", "_found").unionByName(large.select("_left", "_found"))

    lacking = left.filter(reduce(or_, [F.col(c).isNull() for c in needed]))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in right.select(*columns).schema.fields}
    return found.select("_left.*", "_found.*").unionByName(lacking.withColumns(nothing))
