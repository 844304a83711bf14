"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, **columns: str) -> DataFrame:
    """The whole row as struct ``doc``, and the named columns beside it.

    Working columns added later then never clash with a column of the table.
    """
    return docs.select(F.struct("*").alias("doc"), *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of the row in ``doc``, some with a new value."""
    return df.select(*[
        (replaced[c] if c in replaced else F.col("doc").getField(c)).alias(c) for c in columns
    ])


def training_row(doc_id: Column) -> Column:
    """Whether a row's label may be learnt from; the other third is held out."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def by_slices(fn: Callable[[list[Any]], Any]) -> Callable[[pa.Array], Any]:
    """Apply a function on Python values to an Arrow array, a few hundred values at a time."""

    def run(column: pa.Array) -> list[Any]:
        out: list[Any] = []
        for start in range(0, len(column), SLICE_ROWS):
            out.extend(fn(column.slice(start, SLICE_ROWS).to_pylist()))
        return out

    return run
