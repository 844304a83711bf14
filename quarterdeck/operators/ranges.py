"""Work along one order without a task that sees all of it.

A table is cut into cells, ranges of its order with about as many rows each. Inside a cell ordinary windows do; what
comes before a cell is known from one row per cell, of which there are as many as tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.session import materialize

CELL = "_cell"


def in_cells(df: DataFrame, order: Sequence[str | Column], cells: int | None = None) -> DataFrame:
    """The rows with the number of their cell, which grows with the order; rows of equal order share a cell.

    ``cells`` is how many there are at most, by default the number of shuffle partitions.

    The table is written, so that the cells stay as they are however often it is read or a task is tried again.
    """
    ranged = df.repartitionByRange(*order) if cells is None else df.repartitionByRange(cells, *order)
    return materialize(ranged.withColumn(CELL, F.spark_partition_id()))


def carried(cells: DataFrame, value: str, order: Column, out: str = "_carried") -> DataFrame:
    """Per cell the last non-null ``value`` of all earlier cells, null if there is none."""
    closing = cells.groupBy(CELL).agg(F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("_closing"))
    earlier = W.orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    return closing.select(CELL, F.last("_closing", ignorenulls=True).over(earlier).alias(out))


def totals_before(cells: DataFrame, amount: Column, by: Sequence[str] = (), out: str = "_before") -> DataFrame:
    """Per cell (and ``by``) the sum of ``amount`` over all earlier cells, 0 for the first."""
    sums = cells.groupBy(*by, CELL).agg(F.sum(amount).alias("_sum"))
    earlier = W.partitionBy(*by).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*by, CELL, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(out))


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Each row's place, from 1, among the rows of its group, null groups included.

    A group of any size is spread over the cells of one order over all rows.
    """
    cells = in_cells(df, [*by, *order])
    inside = F.row_number().over(W.partitionBy(*by, CELL).orderBy(*order))
    before = totals_before(cells, F.lit(1), by)
    names = {c: f"_b_{i}" for i, c in enumerate([*by, CELL])}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    placed = cells.withColumn(out, inside.cast("long")).join(before.withColumnsRenamed(names), same)
    return placed.withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)
