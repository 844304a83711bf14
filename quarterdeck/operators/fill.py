"""Filling missing values with column medians and group medians.

``scale`` is the number of decimals the columns have. Given it, medians are
taken over whole numbers and divided once; without it, over the doubles. NaN
counts as missing, like null: it is left out of medians and filled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from quarterdeck.functions.exact import fixed, from_sortable, with_sortable
from quarterdeck.operators.profile import columns_with_nulls
from quarterdeck.operators.rows import known
from quarterdeck.operators.skew import HOT_ROWS, hot_groups
from quarterdeck.session import materialize

#: Bits of a value that a pass tells apart, and passes.
DIGIT_BITS = 22
STEPS = 3


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """0 for nulls in the given columns, or in every numeric column not excluded."""
    return df.fillna(0, subset=list(columns) if columns is not None else numeric_columns(df, exclude))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema, keys and labels excluded."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude
    ]


def _present(df: DataFrame, column: str) -> Column:
    """A column with NaN as null, like any missing value."""
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return F.nanvl(F.col(column), F.lit(None).cast(df.schema[column].dataType))
    return F.col(column)


def _units(column: Column, scale: int | None) -> Column:
    return column.cast("double") if scale is None else fixed(column, scale)


def _unit(scale: int | None) -> Column:
    return F.lit(1.0 if scale is None else float(10**scale))


def _long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: int | None) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("_column"), _units(_present(df, c), scale).alias("_units")) for c in columns]
    )
    return df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*").filter(F.col("_units").isNotNull())


def _selected_medians(values: DataFrame, keys: Sequence[str], scale: int | None) -> DataFrame:
    """Exact medians of groups of any size, in three passes over 22 bits each at most.

    Values become longs in the same order. The first pass counts rows by the highest bits and finds, by adding
    up, which bits the two middle rows have; each further pass counts only the rows that agree so far, which
    two comparisons tell, by their next bits. A pass gives four million counts a group at most, combined before its shuffle, so no
    task gathers or ranks the values themselves, whatever they are.
    """
    keys = [*keys, "_column"]

    def keyed(rows: DataFrame) -> DataFrame:
        return with_sortable(rows, "_units", "_key") if scale is None else rows.withColumn("_key", F.col("_units"))

    def unit(bits: Column) -> Column:
        return from_sortable(bits) if scale is None else bits

    def digit(step: int) -> Column:
        shifted = F.shiftright("_key", DIGIT_BITS * (STEPS - 1 - step))
        return shifted if step == 0 else shifted.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))

    counts = keyed(values).groupBy(*keys, digit(0).alias("_digit")).agg(F.count(F.lit(1)).alias("_same"))
    upward = W.partitionBy(*keys).orderBy("_digit").rowsBetween(W.unboundedPreceding, 0)
    counted = counts.withColumns({
        "_upto": F.sum("_same").over(upward), "_n": F.sum("_same").over(W.partitionBy(*keys)),
    })
    below = F.col("_upto") - F.col("_same")
    middle = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    # Two rows a group: the bits found so far of each middle row, and its place among the rows that agree.
    found = counted.select(*keys, "_digit", "_upto", below.alias("_below"), F.posexplode(middle).alias("_which", "_place")).filter(
        (F.col("_upto") >= F.col("_place")) & (F.col("_below") < F.col("_place"))
    ).select(*keys, "_which", F.col("_digit").alias("_bits"), (F.col("_place") - F.col("_below")).alias("_place"))
    each = [*keys, "_which"]
    for step in range(1, STEPS):
        # Written, so that every pass is a small plan of its own.
        found = materialize(found)
        rest = 1 << DIGIT_BITS * (STEPS - step)
        first = F.col("_bits") * F.lit(rest)
        bounds = found.withColumns({"_from": unit(first), "_to": unit(first + F.lit(rest - 1))})
        near = values.join(F.broadcast(bounds), keys).filter(F.col("_units").between(F.col("_from"), F.col("_to")))
        counts = keyed(near).groupBy(*each, "_bits", "_place", digit(step).alias("_digit")).agg(F.count(F.lit(1)).alias("_same"))
        upward = W.partitionBy(*each).orderBy("_digit").rowsBetween(W.unboundedPreceding, 0)
        placed = counts.withColumn("_upto", F.sum("_same").over(upward)).withColumn("_below", below)
        found = placed.filter((F.col("_upto") >= F.col("_place")) & (F.col("_below") < F.col("_place"))).select(
            *each, (F.col("_bits") * (1 << DIGIT_BITS) + F.col("_digit")).alias("_bits"), (F.col("_place") - F.col("_below")).alias("_place")
        )
    found = materialize(found)
    value = unit(F.col("_bits")).cast("double")
    return found.groupBy(*keys).agg((
        (F.max(F.when(F.col("_which") == 0, value)) + F.max(F.when(F.col("_which") == 1, value))) / F.lit(2.0)
    ).alias("_median"))


def _widen(
    medians: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: int | None
) -> DataFrame:
    aggs = [
        (F.max(F.when(F.col("_column") == c, F.col("_median"))) / _unit(scale)).alias(c) for c in columns
    ]
    return medians.groupBy(*keys).agg(*aggs)


def column_medians(
    df: DataFrame, columns: Sequence[str], scale: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """One row with the exact median of each column, computed without gathering the column.

    Nulls and NaN do not count. ``accuracy`` has no effect any more, as no estimate is made.
    """
    return _widen(_selected_medians(_long_form(df, [], columns, scale), [], scale), [], columns, scale)


def large_group_medians(
    large: DataFrame, key: str, columns: Sequence[str], scale: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """Exact medians of groups too large to sort in one task, one row per group.

    Meant for few groups: two rows for each and column are broadcast. ``accuracy`` has no effect any more.
    """
    return _widen(_selected_medians(_long_form(large, [key], columns, scale), [key], scale), [key], columns, scale)


def fill_column_median(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    scale: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Replace nulls by the column median of ``fit_on`` (the table itself if not given).

    Pass the training rows as ``fit_on`` to keep test rows out of the medians.
    """
    if not columns:
        return df
    medians = column_medians(fit_on if fit_on is not None else df, columns, scale, accuracy)
    values = medians.select(F.struct(*columns).alias("_m")).scalar()
    return df.withColumns({c: F.coalesce(_present(df, c), values[c]) for c in columns})


def fill_group_median(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    default: float | None = 0.0,
    scale: int | None = None,
    hot_rows: int | None = HOT_ROWS,
    accuracy: int | None = None,
) -> DataFrame:
    """Replace nulls by the median of the row's group, then by ``default`` if given.

    Ordinary groups are filled by one window over the group: a single shuffle,
    one group in memory at a time, nothing to join back. Hot groups are not
    shuffled at all; their few medians are broadcast to them. With ``hot_rows``
    None no group is looked on as hot, for tables whose groups are bounded
    anyway, such as a panel with a row per quarter. Rows without a key have no
    group.
    """
    fallback = [] if default is None else [F.lit(default)]

    def filled(rows: DataFrame, median: Callable[[str], Column | None]) -> DataFrame:
        steps = {c: [_present(df, c), *[m for m in [median(c)] if m is not None], *fallback] for c in columns}
        return rows.withColumns({c: F.coalesce(*values) for c, values in steps.items()}).select(*df.columns)

    def in_window(c: str) -> Column:
        return F.median(_units(_present(df, c), scale)).over(W.partitionBy(key)) / _unit(scale)

    keyed = known(df, [key])
    keyless = filled(df.filter(F.col(key).isNull()), lambda c: None)
    if hot_rows is None:
        return filled(keyed, in_window).unionByName(keyless)
    hot = hot_groups(keyed.select(key), [key], hot_rows)
    if hot.isEmpty():
        return filled(keyed, in_window).unionByName(keyless)
    hot = F.broadcast(hot)
    large = keyed.join(hot, key, "left_semi")
    # One row per hot group, as few as the groups broadcast above.
    medians = large_group_medians(large, key, columns, scale, accuracy).withColumnsRenamed(
        {c: f"_m_{c}" for c in columns}
    )
    ordinary = filled(keyed.join(hot, key, "left_anti"), in_window)
    large = filled(large.join(F.broadcast(medians), key, "left"), lambda c: F.col(f"_m_{c}"))
    return ordinary.unionByName(large).unionByName(keyless)


def fill_two_stage(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    scale: int | None = None,
    hot_rows: int | None = HOT_ROWS,
    accuracy: int | None = None,
) -> DataFrame:
    """Group median first, then the median of the column as filled so far.

    The half-filled table is read for the medians and for the result, so it is
    written once in between.
    """
    first = materialize(fill_group_median(df, key, columns, None, scale, hot_rows, accuracy))
    open_columns = columns_with_nulls(first, columns)
    if not open_columns:
        return first
    # One more decimal, since the median of an even group lies between two values.
    return fill_column_median(first, open_columns, None, None if scale is None else scale + 1, accuracy)
