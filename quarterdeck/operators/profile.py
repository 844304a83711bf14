"""Data-quality profiles, class balance and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_mean, exact_total, fixed, product_total, ratio


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that have nulls, and how many, from a single pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.explode(cells).alias("_c")).select("_c.*").filter("nulls > 0")


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that have nulls, from one pass that brings back a single row."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for c, n in zip(columns, counts) if n]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight per class such that every class adds up to the same total."""
    counts = class_counts(df.dropna(subset=[label]), label)
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    weight = totals["rows"].cast("double") / (totals["classes"] * F.col("n")).cast("double")
    return counts.select(label, "n", weight.alias(out))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    # One row per class.
    return df.join(F.broadcast(class_weights(df, label, out).drop("n")), label, "left")


def require_rows(df: DataFrame, minimum: int) -> int:
    """Row count; raises if it is below ``minimum``."""
    n = df.count()
    if n < minimum:
        raise ValueError(f"{n} rows, expected at least {minimum}")
    return n


def correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]], scales: dict[str, int] | None = None
) -> DataFrame:
    """Pearson correlation of each pair of columns, as rows ``(left, right, corr)``.

    One pass over the rows where both are known; null if a side does not vary.
    With ``scales``, the numbers of decimals by column (0 where it has none), the
    sums are exact; every row is unfolded into its pairs, which each task sums up
    before the shuffle, so what is shuffled is a row per pair and task.
    """
    if scales is None:
        def corr(a: str, b: str) -> Column:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
            return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))

        cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), corr(a, b).alias("corr")) for a, b in pairs]
        return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    used = sorted({c for pair in pairs for c in pair})
    units = df.select(*[fixed(F.col(c), scales.get(c, 0)).alias(c) for c in used])

    def cell(i: int, a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.struct(F.lit(i).alias("_i"), F.when(both, F.col(a)).alias("x"), F.when(both, F.col(b)).alias("y"))

    cells = F.array(*[cell(i, a, b) for i, (a, b) in enumerate(pairs)])
    x, y = F.col("x"), F.col("y")
    sums = (
        units.select(F.explode(cells).alias("_c"))
        .select("_c.*")
        .groupBy("_i")
        .agg(
            F.count(x).cast("decimal(38,0)").alias("n"),
            exact_total(x).alias("sx"),
            exact_total(y).alias("sy"),
            product_total(x, x).alias("sxx"),
            product_total(y, y).alias("syy"),
            product_total(x, y).alias("sxy"),
        )
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    across = (n * F.col("sxy") - sx * sy).cast("double")
    left, right = (n * F.col("sxx") - sx * sx).cast("double"), (n * F.col("syy") - sy * sy).cast("double")
    corr = across / F.nullif(F.sqrt(left) * F.sqrt(right), F.lit(0.0))
    names = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])
    return sums.select(F.get(names, F.col("_i")).alias("_p"), corr.alias("corr")).select("_p.*", "corr")


def label_correlations(
    df: DataFrame, features: Sequence[str], label: str, scales: dict[str, int] | None = None
) -> DataFrame:
    """Correlation of every feature with the label."""
    rows = correlations(df, [(f, label) for f in features], scales)
    return rows.select(F.col("left").alias("feature"), "corr")


def redundant_features(
    df: DataFrame, features: Sequence[str], threshold: float = 0.95, scales: dict[str, int] | None = None
) -> DataFrame:
    """Features strongly correlated with one listed before them."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    strong = correlations(df, pairs, scales).filter(F.abs("corr") > F.lit(threshold))
    return strong.select(F.col("right").alias("feature")).distinct()


def panel_summary(
    df: DataFrame, entity: str, period: str, ts: str, flag: str, value: str, scale: int | None = None
) -> DataFrame:
    """Size, coverage, date range, flag count and rate, and a mean, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(entity).alias("n_entities"),
        F.count_distinct(period).alias("n_periods"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.sum(flag).alias("n_flagged"),
        ratio(F.sum(flag), F.count(flag)).alias("flag_rate"),
        exact_mean(F.col(value), scale).alias("mean_value"),
    )
