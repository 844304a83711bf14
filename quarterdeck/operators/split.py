"""Repeatable stratified split, scaling, encoding and one-hot columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_mean, exact_std_pop
from quarterdeck.operators.ranges import rank_rows
from quarterdeck.operators.rows import known

PREFIX = 4  # hex digits of the hash, 65,536 cells per class


def stratified_split(
    df: DataFrame, label: str, key: str, test_percent: int = 20, seed: int = 42, out: str = "is_test",
    at_least_one: bool = False,
) -> DataFrame:
    """Mark ``test_percent`` of every class, rounded down, as test rows. ``key`` must be unique.

    With ``at_least_one`` every class of two rows or more has a test row, however small the share.

    Rows are ranked within their class by a hash of ``key``, so the split does
    not depend on partitioning. No class is sorted: counts per hash prefix show
    in which cell the cut falls, only the rows of that cell are ranked to get
    the hash at the cut, and the rows are then compared with that one value.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    cells = (
        hashed.groupBy(label, F.substring("_h", 1, PREFIX).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    of_class = W.partitionBy(label)
    upward = of_class.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    size = F.sum("_n").over(of_class)
    wanted = F.floor(size * F.lit(test_percent) / F.lit(100))
    if at_least_one:
        wanted = F.when(size >= 2, F.greatest(wanted, F.lit(1).cast("long"))).otherwise(wanted)
    placed = cells.select(
        label,
        "_cell",
        "_n",
        F.sum("_n").over(upward).alias("_end"),
        wanted.alias("_wanted"),
    )
    cut_cells = placed.filter((F.col("_end") >= F.col("_wanted")) & (F.col("_end") - F.col("_n") < F.col("_wanted")))
    # One cell per class, hence one row per class here and in ``cuts``.
    in_cut_cell = hashed.select(label, "_h", F.substring("_h", 1, PREFIX).alias("_cell")).join(
        F.broadcast(cut_cells), [label, "_cell"]
    )
    place = F.row_number().over(W.partitionBy(label, "_cell").orderBy("_h"))
    cuts = (
        in_cut_cell.withColumn("_place", place)
        .filter(F.col("_place") == F.col("_wanted") - (F.col("_end") - F.col("_n")))
        .select(label, F.col("_h").alias("_cut"))
    )
    marked = hashed.join(F.broadcast(cuts), label, "left")
    return marked.withColumn(out, F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)).cast("int")).select(
        *df.columns, out
    )


def scale_columns(
    df: DataFrame, fit_on: DataFrame, columns: Mapping[str, int | None], suffix: str = "_z"
) -> DataFrame:
    """Subtract the mean and divide by the population deviation, both taken from ``fit_on``.

    ``columns`` maps a column to its number of decimals, for exact moments, or to
    None for those of the doubles. A column that does not vary is only centred.
    """

    # A row per cell, so that the code of the exact sums is there once and not for every column: with that of many columns
    # it grows beyond what Java compiles. Two numbers a column come back. They go into the result as numbers: its plan would
    # hold the plan behind them once for every use of one.
    stats = {}
    for scale in set(columns.values()):
        names = [c for c, s in columns.items() if s == scale]
        cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)])
        value = F.col("value")
        moments = fit_on.select(F.inline(cells)).groupBy("column").agg(exact_mean(value, scale), exact_std_pop(value, scale))
        stats |= {names[i]: (centre, deviation) for i, centre, deviation in moments.collect()}

    def scaled(c: str) -> Column:
        centre, deviation = stats.get(c, (None, None))
        divisor = 1.0 if deviation == 0 else deviation
        return (F.col(c) - F.lit(centre).cast("double")) / F.lit(divisor).cast("double")

    return df.withColumns({c + suffix: scaled(c) for c in columns})


def fit_label_codes(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Per column a table of its distinct texts, ``value``, and their ``code``: 0, 1, … in alphabetical order.

    The values are ranked where they are, over ranges; any number of them may occur.
    """
    codes = {}
    for c in columns:
        values = known(df.select(F.col(f"`{c}`").cast("string").alias("value")), ["value"]).distinct()
        codes[c] = rank_rows(values, [], ["value"], "code").select("value", (F.col("code") - 1).cast("int").alias("code"))
    return codes


def encode_labels(df: DataFrame, columns: Sequence[str], codes: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``<column>_encoded``; null and values without a code get the number of codes."""
    codes = codes or fit_label_codes(df, columns)
    coded = df
    for i, c in enumerate(columns):
        table = codes[c].select(F.col("value").alias(f"_value_{i}"), F.col("code").alias(f"_code_{i}"))
        unseen = codes[c].agg(F.count(F.lit(1)).cast("int")).scalar()
        coded = coded.join(table, coded[f"`{c}`"].cast("string") == table[f"_value_{i}"], "left")
        coded = coded.withColumn(f"{c}_encoded", F.coalesce(F.col(f"_code_{i}"), unseen)).drop(f"_value_{i}", f"_code_{i}")
    return coded


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column per listed value."""
    prefix = prefix if prefix is not None else f"{column}_"
    return df.withColumns(
        {f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )
