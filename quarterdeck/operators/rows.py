"""Small row helpers the operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the given columns, as plain filters the file scan can use."""
    return reduce(lambda d, c: d.filter(F.col(c).isNotNull()), columns, df)


def order_key(columns: Sequence[str]) -> Column:
    """One value to order by; a lone column stays itself, which hash aggregates can hold."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
