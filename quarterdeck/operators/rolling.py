"""Rolling indicators per entity, counted in rows.

All indicators of one call share one shuffle and one sort. A rolling sum is the
difference of two running sums, exact because they are kept in fixed point, so
the cost per row does not grow with the window length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.exact import WIDE, fixed, spread
from quarterdeck.functions.keys import day_start
from quarterdeck.operators.rows import known, order_key
from quarterdeck.operators.skew import BLOCK, HOT_ROWS, drop_halo, has_key, hot_groups, of_series, split_series


def _square(units: Column) -> Column:
    return (units.cast("decimal(19,0)") * units.cast("decimal(19,0)")).cast(WIDE)


def _last_n(running: str, n: int, series) -> Column:
    """Sum of the last ``n`` rows out of a running sum."""
    now = F.coalesce(F.col(running), F.lit(0))
    return now - F.coalesce(F.lag(running, n).over(series), F.lit(0))


def _as_they_are(blocks, series, price, volume, sma, volatility, momentum, rsi, volume_ratio):
    """The indicators over doubles, one frame per window; the table and the names of its new columns."""

    def last(n: int):
        return series.rowsBetween(-(n - 1), 0)

    value = F.col(price).cast("double")
    out: dict[str, Column] = {f"sma_{n}": F.avg(value).over(last(n)) for n in sma}
    out |= {f"volatility_{n}d": F.stddev_samp(value).over(last(n)) for n in volatility}
    for n in momentum:
        out[f"momentum_{n}d"] = F.col(price) / F.nullif(F.lag(price, n).over(series), F.lit(0.0)) - F.lit(1.0)
    if rsi:
        blocks = blocks.withColumn("_d", value - F.lag(value, 1).over(series))
    for n in rsi:
        gain = F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))).over(last(n)), F.lit(0.0))
        loss = F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))).over(last(n)), F.lit(0.0))
        out[f"rsi_{n}"] = F.lit(100.0) * gain / F.nullif(gain + loss, F.lit(0.0))
    for n in volume_ratio:
        amount = F.col(volume).cast("double")
        out[f"volume_ratio_{n}"] = amount / F.nullif(F.avg(amount).over(last(n)), F.lit(0.0))
    return blocks.withColumns(out), list(out)


def indicators(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    price: str,
    volume: str | None = None,
    *,
    sma: Sequence[int] = (),
    volatility: Sequence[int] = (),
    momentum: Sequence[int] = (),
    rsi: Sequence[int] = (),
    volume_ratio: Sequence[int] = (),
    scale: int | None = None,
    volume_scale: int = 0,
    day: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Append the asked-for indicator columns.

    ``order`` is the time column followed by a tie-breaking key; together with
    the entity they must be unique. ``day`` is the unit hot entities are cut at
    and defaults to the calendar day of the time column.

    Added columns: ``sma_<n>`` mean of the last n rows, ``volatility_<n>d``
    sample deviation (null below two values), ``momentum_<n>d`` change against
    n rows earlier, ``rsi_<n>`` relative strength from plain means of gains and
    losses, ``volume_ratio_<n>`` volume against its own mean. Frames count rows,
    nulls included; means skip nulls. A division by zero gives null. Rows without an entity stay, with nulls.

    Prices are taken as they are. With ``scale`` they count as numbers of so many
    decimals (volumes of ``volume_scale``), sums are exact and the same on every run,
    and the cost per row does not grow with the window.
    """
    lookback = max(
        [n - 1 for n in (*sma, *volatility, *volume_ratio)] + list(momentum) + list(rsi) + [1]
    )
    blocks = split_series(df, [entity], day if day is not None else day_start(F.col(order[0])), lookback, hot_rows)
    series = W.partitionBy(entity, BLOCK).orderBy(*order)
    if scale is None:
        own = _as_they_are(blocks, series, price, volume, sma, volatility, momentum, rsi, volume_ratio)
        return drop_halo(own[0].withColumns(of_series([entity], {c: F.col(c) for c in own[1]}))).select(*df.columns, *own[1])
    running = series.rowsBetween(W.unboundedPreceding, W.currentRow)

    work = blocks.withColumn("_p", fixed(F.col(price), scale))
    if volume_ratio:
        work = work.withColumn("_v", fixed(F.col(volume), volume_scale))
    if rsi:
        work = work.withColumn("_d", F.col("_p") - F.lag("_p", 1).over(series))
        work = work.withColumns(
            {
                "_gain": F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.lit(0)),
                "_loss": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(F.lit(0)),
            }
        )

    sums: dict[str, Column] = {}
    if sma or volatility:
        sums["_pn"] = F.count("_p").over(running)
        sums["_ps"] = F.sum("_p").over(running)
    if volatility:
        sums["_pq"] = F.sum(_square(F.col("_p"))).over(running)
    if rsi:
        sums["_gs"] = F.sum("_gain").over(running)
        sums["_ls"] = F.sum("_loss").over(running)
    if volume_ratio:
        sums["_vn"] = F.count("_v").over(running)
        sums["_vs"] = F.sum("_v").over(running)
    work = work.withColumns(sums) if sums else work

    unit = F.lit(float(10**scale))
    frames: dict[str, Column] = {}
    for n in sorted({*sma, *volatility}):
        frames[f"_pn{n}"] = _last_n("_pn", n, series)
        frames[f"_ps{n}"] = _last_n("_ps", n, series)
    for n in volatility:
        frames[f"_pq{n}"] = _last_n("_pq", n, series).cast(WIDE)
    for n in rsi:
        frames[f"_gs{n}"] = _last_n("_gs", n, series)
        frames[f"_ls{n}"] = _last_n("_ls", n, series)
    for n in volume_ratio:
        frames[f"_vn{n}"] = _last_n("_vn", n, series)
        frames[f"_vs{n}"] = _last_n("_vs", n, series)
    for n in momentum:
        frames[f"_base{n}"] = F.lag(price, n).over(series)
    work = work.withColumns(frames)

    out: dict[str, Column] = {}
    for n in sma:
        values = F.nullif(F.col(f"_pn{n}").cast("double") * unit, F.lit(0.0))
        out[f"sma_{n}"] = F.col(f"_ps{n}").cast("double") / values
    for n in volatility:
        out[f"volatility_{n}d"] = spread(
            F.col(f"_pn{n}"), F.col(f"_ps{n}"), F.col(f"_pq{n}"), scale, ddof=1
        )
    for n in momentum:
        out[f"momentum_{n}d"] = F.col(price) / F.nullif(F.col(f"_base{n}"), F.lit(0.0)) - F.lit(1.0)
    for n in rsi:
        gain, loss = F.col(f"_gs{n}").cast("double"), F.col(f"_ls{n}").cast("double")
        out[f"rsi_{n}"] = F.lit(100.0) * gain / F.nullif(gain + loss, F.lit(0.0))
    for n in volume_ratio:
        mean = F.col(f"_vs{n}").cast("double") / F.nullif(F.col(f"_vn{n}").cast("double"), F.lit(0.0))
        out[f"volume_ratio_{n}"] = F.col("_v").cast("double") / F.nullif(mean, F.lit(0.0))
    work = work.withColumns(of_series([entity], out))
    return drop_halo(work).select(*df.columns, *out)


def trailing_rank(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    value: str,
    n: int,
    out: str = "trailing_rank",
    day: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Where a value lies between the lowest (0) and highest (1) of its last ``n`` rows."""
    blocks = split_series(df, [entity], day if day is not None else day_start(F.col(order[0])), n - 1, hot_rows)
    frame = W.partitionBy(entity, BLOCK).orderBy(*order).rowsBetween(-(n - 1), 0)
    work = blocks.withColumns({"_lo": F.min(value).over(frame), "_hi": F.max(value).over(frame)})
    place = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return drop_halo(work.withColumns(of_series([entity], {out: place}))).select(*df.columns, out)


def trailing_percent_rank(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    value: str,
    n: int,
    out: str = "trailing_percent_rank",
    day: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Share of the other values among the last ``n`` rows that lie below a row's own.

    Nulls among them do not count; null for a null value or where there is no other value. A row holds the ``n``
    values of its frame while it is worked on, never more.
    """
    blocks = split_series(df, [entity], day if day is not None else day_start(F.col(order[0])), n - 1, hot_rows)
    frame = W.partitionBy(entity, BLOCK).orderBy(*order).rowsBetween(-(n - 1), 0)
    work = blocks.withColumn("_near", F.collect_list(value).over(frame))
    below = F.size(F.filter("_near", lambda other: other < F.col(value))).cast("double")
    others = F.nullif(F.size("_near").cast("double") - F.lit(1.0), F.lit(0.0))
    share = F.when(F.col(value).isNotNull(), below / others)
    return drop_halo(work.withColumns(of_series([entity], {out: share}))).select(*df.columns, out)


def quarter_to_date_return(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    price: str,
    quarter: Column,
    out: str = "qtd_return",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Change against the entity's first price of the same quarter.

    One window per entity and quarter. Quarters with more than ``hot_rows`` rows
    are not gathered: their first prices come from an aggregate, which combines
    before its shuffle, and are broadcast back. Rows without an entity or quarter stay, with a null.
    """
    keys = [entity, "_q"]
    work = df.withColumn("_q", quarter)
    hot = F.broadcast(hot_groups(known(work.select(*keys), keys), keys, hot_rows))
    work = work.withColumn("_apart", F.when(~has_key(keys), F.xxhash64(*order)))
    in_order = W.partitionBy(*keys, "_apart").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ordinary = work.join(hot, keys, "left_anti").withColumn("_first", F.first(price).over(in_order))
    large = work.join(hot, keys, "left_semi")
    # One row per hot group, as few as the groups broadcast above.
    firsts = large.groupBy(*keys).agg(F.min_by(price, order_key(order)).alias("_first"))
    large = large.join(F.broadcast(firsts), keys)
    change = F.col(price) / F.nullif(F.col("_first"), F.lit(0.0)) - F.lit(1.0)
    both = ordinary.unionByName(large.select(*ordinary.columns))
    return both.withColumns(of_series(keys, {out: change})).select(*df.columns, out)


def change_over(df: DataFrame, keys: list[str], period: str, value: str, lag: int, out: str) -> DataFrame:
    """Relative change against ``lag`` periods earlier, on a table with one row per key and period.

    ``period`` counts periods as whole numbers. The frame holds just the row
    whose period is ``lag`` less, so the result is right where one is missing. A
    key has as many rows as the calendar has periods.
    """
    before = W.partitionBy(*keys).orderBy(period).rangeBetween(-lag, -lag)
    past = F.first(value).over(before)
    return df.withColumn(out, F.col(value) / F.nullif(past, F.lit(0.0)) - F.lit(1.0))
