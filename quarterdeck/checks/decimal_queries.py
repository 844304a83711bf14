"""Sums, means, deviations and rolling columns over values with six decimals, taken as they are.

Prices are the test tables' cents as millionths. Where the SQL sums doubles, it does so as whole multiples of 2**-72
in 128 bits, which is exact for them, and rounds once. Deviations and rolling columns are compared to 6 to 10 decimals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import prices, quarter, table, with_views
from quarterdeck.functions.exact import exact_sum, fixed
from quarterdeck.functions.keys import quarter_key
from quarterdeck.operators import joins, profile, rolling, rollup, split

MILLION = 1_000_000
UNITS = f"CAST(round_even(\"Close\" * 100, 0) AS BIGINT) % {100 * MILLION + 7}"
FINE = with_views("prices") + f""", fine AS (SELECT ticker, "Date", row_id, {quarter('"Date"')} AS quarter,
    {UNITS} AS u, ({UNITS})::DOUBLE / {MILLION} AS x, (row_id % 997 + 1)::DOUBLE / 997 AS w FROM prices)"""


def steady(x: str) -> str:
    """The sum of positive doubles, whole multiples of 2**-72, without an error but the last rounding."""
    whole = f"sum(({x} * {2**72}.0::DOUBLE)::HUGEINT)"
    half = "1125899906842624"
    return f"""((({whole} // {half})::DOUBLE * {half}.0::DOUBLE + ({whole} % {half})::DOUBLE) / {2**72}.0::DOUBLE)"""


def spread(ddof: int) -> str:
    """Deviation of whole millionths."""
    wide = "(count(*) * sum(u::HUGEINT * u) - sum(u)::HUGEINT * sum(u))::DOUBLE"
    return f"(sqrt({wide} / nullif(count(*)::DOUBLE * (count(*) - {ddof}), 0)) / {MILLION})"


def _fine(spark, d):
    units = fixed(F.col("Close")) % F.lit(100 * MILLION + 7)
    return prices(spark, d).select(
        "ticker", "Date", "row_id", quarter_key(F.col("Date")).alias("quarter"),
        (units.cast("double") / F.lit(float(MILLION))).alias("x"),
        ((F.col("row_id") % 997 + 1).cast("double") / F.lit(997.0)).alias("w"),
    )


@query(
    "fin_quarter_decimals",
    FINE + f"""SELECT ticker, quarter, {steady('x')} / count(x)::DOUBLE AS q_avg_close,
    coalesce(round({spread(1)}, 8), 0) AS q_volatility, min(x) AS q_min_close, max(x) AS q_max_close,
    {steady('w')} / count(w)::DOUBLE AS q_avg_volume, {steady('w')} AS q_total_volume FROM fine GROUP BY ALL""",
)
def fin_quarter_decimals(spark, d):
    out = rollup.price_rollup(_fine(spark, d), ["ticker", "quarter"], "x", "w")
    return out.withColumn("q_volatility", F.round("q_volatility", 8))


@query(
    "mean_decimals",
    FINE + f"""SELECT quarter, {steady('x')} / count(x)::DOUBLE AS q_x, {steady('w')} / count(w)::DOUBLE AS q_w
    FROM fine GROUP BY 1""",
)
def mean_decimals(spark, d):
    return rollup.mean_rollup(_fine(spark, d), ["quarter"], ["x", "w"])


@query(
    "calendar_decimals",
    FINE + f"""SELECT quarter, arg_max(w, "Date"::VARCHAR || lpad(row_id::VARCHAR, 20, '0')) AS w,
    {steady('x')} / count(x)::DOUBLE AS x FROM fine GROUP BY 1""",
)
def calendar_decimals(spark, d):
    rows = _fine(spark, d).withColumn("at", F.struct("Date", "row_id"))
    return rollup.calendar_rollup(rows, F.col("quarter"), "at", last=["w"], mean={"x": None})


@query(
    "weighted_mean_fraction",
    FINE + f"SELECT ticker, {steady('(x * w)')} / nullif({steady('w')}, 0) AS weighted_mean FROM fine GROUP BY 1",
)
def weighted_mean_fraction(spark, d):
    return rollup.weighted_mean(_fine(spark, d), ["ticker"], "x", "w")


@query(
    "labels_decimals",
    FINE + f"""SELECT ticker, quarter, arg_min(row_id % 2, ("Date", row_id)) AS kept, {steady('x')} AS x
    FROM fine GROUP BY ALL""",
)
def labels_decimals(spark, d):
    events = _fine(spark, d).withColumn("kept", F.col("row_id") % 2)
    return joins.label_rows(events, ["ticker", "quarter"], "total", ["Date", "row_id"], "kept", "x")


@query(
    "summary_decimals",
    FINE + f"""SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_entities, count(DISTINCT quarter) AS n_periods,
    min("Date") AS first, max("Date") AS last, sum(row_id % 2)::BIGINT AS n_flagged,
    sum(row_id % 2)::DOUBLE / count(*) AS flag_rate, {steady('x')} / count(x)::DOUBLE AS mean_value FROM fine""",
)
def summary_decimals(spark, d):
    rows = _fine(spark, d).withColumn("odd", F.col("row_id") % 2)
    return profile.panel_summary(rows, "ticker", "quarter", "Date", "odd", "x")


@query(
    "zscore_decimals",
    FINE + f""", m AS (SELECT {steady('x')} / count(x)::DOUBLE AS mean, {spread(0)} AS dev FROM fine WHERE row_id % 5 <> 0)
    SELECT row_id, round((x - (SELECT mean FROM m)) / (SELECT dev FROM m), 8) AS x_z FROM fine""",
)
def zscore_decimals(spark, d):
    rows = _fine(spark, d).select("row_id", "x")
    scaled = split.scale_columns(rows, rows.filter("row_id % 5 != 0"), {"x": None})
    return scaled.select("row_id", F.round("x_z", 8).alias("x_z"))


@query(
    "sum_fractions",
    f"""SELECT l_returnflag, {steady('(l_extendedprice * l_discount / 7)')} AS total FROM lineitem GROUP BY 1""",
)
def sum_fractions(spark, d):
    rows = table(spark, d, "lineitem")
    amount = F.col("l_extendedprice") * F.col("l_discount") / F.lit(7.0)
    return rows.groupBy("l_returnflag").agg(exact_sum(amount).alias("total"))


def _frame(n: int) -> str:
    return f'(PARTITION BY ticker ORDER BY "Date", row_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'


_N, _S, _Q = (f"{f} OVER {_frame(20)}" for f in ("count(*)", "sum(u)", "sum(u::HUGEINT * u)"))
_UP, _DOWN = (f"(sum(greatest({s}delta, 0)) OVER {_frame(14)})::DOUBLE" for s in ("", "-"))


@query(
    "rolling_decimals",
    FINE + f""", moves AS (SELECT *, coalesce(u - lag(u) OVER (PARTITION BY ticker ORDER BY "Date", row_id), 0) AS delta
    FROM fine) SELECT row_id, round(({_S})::DOUBLE / ({_N})::DOUBLE / {MILLION}, 10) AS sma_20,
    round(sqrt((({_N}) * ({_Q}) - ({_S})::HUGEINT * ({_S}))::DOUBLE / nullif(({_N})::DOUBLE * (({_N}) - 1), 0)) / {MILLION}, 6)
    AS volatility_20d, round(100.0::DOUBLE * {_UP} / nullif({_UP} + {_DOWN}, 0), 6) AS rsi_14,
    round(w / nullif(avg(w) OVER {_frame(20)}, 0), 6) AS volume_ratio_20 FROM moves""",
)
def rolling_decimals(spark, d):
    out = rolling.indicators(
        _fine(spark, d), "ticker", ["Date", "row_id"], "x", "w", sma=(20,), volatility=(20,), rsi=(14,), volume_ratio=(20,)
    )
    # A mean of up to 20 numbers of six decimals never lies between two numbers of ten.
    digits = {"sma_20": 10, "volatility_20d": 6, "rsi_14": 6, "volume_ratio_20": 6}
    return out.select("row_id", *[F.round(c, n).alias(c) for c, n in digits.items()])
