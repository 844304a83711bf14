"""Keeping a hot entity out of a single task.

Aggregates need no help: Spark combines them before the shuffle. Ordered
windows do, because all rows of a partition key meet in one task. The helpers
here find the few entities with very many rows and cut their series into
blocks of whole days, each carrying the earlier rows its windows look back on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.operators.rows import known

HOT_ROWS = 1_000_000

BLOCK = "_block"
HALO = "_halo"


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows.

    There can be at most ``rows / hot_rows`` of them, a millionth of the input
    by default, which is what makes broadcasting the result safe.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > F.lit(hot_rows)).select(*keys)


def has_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def of_series(keys: list[str], columns: dict[str, Column]) -> dict[str, Column]:
    """Columns that are null on rows without a key."""
    return {name: F.when(has_key(keys), c) for name, c in columns.items()}


def _day_blocks(hot_rows_df: DataFrame, keys: list[str], lookback: int, hot_rows: int) -> DataFrame:
    """For every (entity, day): the block it belongs to and the blocks that need a copy.

    A day is needed by a later block when fewer than ``lookback`` rows lie
    between its last row and the first row of that block. Each day has a row at
    least, so only the next ``lookback`` days have to be looked at.
    """
    days = hot_rows_df.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_size"))
    series = W.partitionBy(*keys).orderBy("_day")
    earlier = F.sum("_size").over(series.rowsBetween(W.unboundedPreceding, -1))
    placed = days.withColumn("_before", F.coalesce(earlier, F.lit(0))).withColumn(
        "_home", F.floor(F.col("_before") / F.lit(hot_rows)).cast("long")
    )
    ahead = F.collect_list(F.struct("_before", "_home")).over(series.rowsBetween(0, lookback))
    reach = F.col("_before") + F.col("_size") + F.lit(lookback)
    return (
        placed.withColumn("_ahead", ahead)
        .withColumn("_reach", reach)
        .select(
            *keys,
            "_day",
            "_home",
            F.array_distinct(
                F.transform(
                    F.filter("_ahead", lambda d: d["_before"] < F.col("_reach")),
                    lambda d: d["_home"],
                )
            ).alias("_needed_by"),
        )
    )


def split_series(
    df: DataFrame, keys: list[str], day: Column, lookback: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add a block number to window by, beside the entity keys.

    Rows of ordinary entities are block 0 and cost nothing extra. Rows of hot
    entities are dealt out to blocks of about ``hot_rows`` rows; a row a later
    block looks back on appears there again with ``_halo`` set, to be dropped
    after the windows. ``day`` is a non-decreasing function of the series order.
    Rows without a key form no series; they stay, dealt out by day however many there are.
    """
    hot = F.broadcast(hot_groups(known(df, keys), keys, hot_rows))
    block = F.when(has_key(keys), F.lit(0).cast("long")).otherwise(F.xxhash64(day))
    ordinary = df.join(hot, keys, "left_anti").withColumns({BLOCK: block, HALO: F.lit(False)})
    large = df.join(hot, keys, "left_semi").withColumn("_day", day)
    blocks = _day_blocks(large, keys, lookback, hot_rows)
    dealt = (
        large.join(blocks, [*keys, "_day"])
        .withColumn(BLOCK, F.explode("_needed_by"))
        .withColumn(HALO, F.col(BLOCK) != F.col("_home"))
    )
    return ordinary.unionByName(dealt.select(*ordinary.columns))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(BLOCK, HALO)
