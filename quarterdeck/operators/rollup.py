"""Roll-ups to quarters, latest values, pivots and rates. All combine before their shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_mean, exact_std, exact_sum, exact_total, fixed, product_total, ratio
from quarterdeck.operators.rows import known, order_key


def last_value(value: str, order: Column) -> Column:
    """Last non-null value in the given order, as an aggregate."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def first_value(value: str, order: Column) -> Column:
    """First non-null value in the given order, as an aggregate."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def price_rollup(
    df: DataFrame,
    keys: Sequence[str],
    price: str,
    volume: str | None = None,
    means: Mapping[str, str] | None = None,
    scale: int | None = None,
    volume_scale: int | None = None,
) -> DataFrame:
    """Mean, deviation, lowest and highest price, volume mean and total, further means.

    A single value has no deviation; it is reported as 0.
    """
    aggs = [
        exact_mean(F.col(price), scale).alias("q_avg_close"),
        F.coalesce(exact_std(F.col(price), scale), F.lit(0.0)).alias("q_volatility"),
        F.min(price).alias("q_min_close"),
        F.max(price).alias("q_max_close"),
    ]
    if volume:
        aggs += [
            exact_mean(F.col(volume), volume_scale).alias("q_avg_volume"),
            exact_sum(F.col(volume), volume_scale).alias("q_total_volume"),
        ]
    aggs += [exact_mean(F.col(c), scale).alias(name) for c, name in (means or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def mean_rollup(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "q_", scale: int | None = None
) -> DataFrame:
    """Means of those listed columns the table has, prefixed and in lower case."""
    present = [c for c in columns if c in df.columns]
    return df.groupBy(*keys).agg(*[exact_mean(F.col(c), scale).alias(prefix + c.lower()) for c in present])


def calendar_rollup(
    df: DataFrame,
    quarter: Column,
    order: str,
    last: Sequence[str] = (),
    mean: Mapping[str, int | None] | None = None,
    out: str = "quarter",
) -> DataFrame:
    """Per quarter the last non-null value of some columns and the mean of others.

    ``mean`` maps a column to its number of decimals, or None for values as they are.
    """
    aggs = [last_value(c, F.col(order)).alias(c) for c in last]
    aggs += [exact_mean(F.col(c), scale).alias(c) for c, scale in (mean or {}).items()]
    return known(df.withColumn(out, quarter), [out]).groupBy(out).agg(*aggs)


def resample_last(
    df: DataFrame, calendar: DataFrame, start: Column, order: str, columns: Sequence[str], out: str
) -> DataFrame:
    """Last non-null value per quarter for every quarter of the calendar, empty ones as nulls."""
    present = (
        df.withColumn(out, start)
        .groupBy(out)
        .agg(*[last_value(c, F.col(order)).alias(c) for c in columns])
    )
    # One row per quarter on both sides.
    return calendar.join(F.broadcast(present), out, "left")


def queue_depth(df: DataFrame, region: str, quarter: Column, out: str = "iso_queue_depth") -> DataFrame:
    """Rows per region and quarter; region spelling is unified before counting."""
    named = df.select(F.upper(region).alias("iso"), quarter.alias("quarter"))
    return known(named, ["iso", "quarter"]).groupBy("iso", "quarter").agg(F.count(F.lit(1)).alias(out))


def queue_total(depth: DataFrame, value: str = "iso_queue_depth") -> DataFrame:
    return depth.groupBy("quarter").agg(F.sum(value).alias(value))


def queue_wide(
    depth: DataFrame, regions: Sequence[str], value: str = "iso_queue_depth", prefix: str = "queue_"
) -> DataFrame:
    """One column per listed region, 0 where a quarter has none."""
    wide = depth.groupBy("quarter").pivot("iso", list(regions)).agg(F.sum(value))
    names = [prefix + r for r in regions]
    return wide.toDF("quarter", *names).fillna(0, subset=names)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key the latest non-null value of every column, each on its own."""
    at = order_key(order)
    return known(df, [key]).groupBy(key).agg(*[last_value(c, at).alias(c) for c in columns])


def latest_rows(df: DataFrame, key: str, newest: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest rows per key.

    Spark keeps only ``n`` rows per key in each task before the shuffle, so a
    key with very many rows arrives as a handful.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*newest))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def rate_by(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Share of 1s and of 0s in a flag per group, nulls left out."""
    known = df.filter(F.col(flag).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(flag), F.count(F.lit(1))).alias("success_rate"),
        ratio(F.count(F.lit(1)) - F.sum(flag), F.count(F.lit(1))).alias("failure_rate"),
    )


def weighted_mean(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, scale: int | None = None, weight_scale: int = 0
) -> DataFrame:
    """Weighted mean of a column, null where the weights sum to zero.

    With ``scale`` values and weights count as numbers of so many decimals, and the sums are exact.
    """
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    if scale is None:
        product, share = F.col(value).cast("double") * F.col(weight), F.col(weight).cast("double")
        mean = exact_sum(F.when(both, product)) / F.nullif(exact_sum(F.when(both, share)), F.lit(0.0))
        return df.groupBy(*keys).agg(mean.alias("weighted_mean"))
    values = F.when(both, fixed(F.col(value), scale))
    weights = F.when(both, fixed(F.col(weight), weight_scale))
    total = exact_total(weights).cast("double") * F.lit(float(10**scale))
    return df.groupBy(*keys).agg(
        (product_total(values, weights).cast("double") / F.nullif(total, F.lit(0.0))).alias("weighted_mean")
    )
