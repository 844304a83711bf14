"""Aggregates over numbers as they are, or over fixed-point values.

Plain sums of doubles depend on the order rows arrive in, so they change with the
partitioning and after a task is retried. Here a sum gives the same bits on every run, whatever the cluster does.

Without a ``scale`` values are taken as they are: each is cut into whole numbers of 24 bits that belong to fixed
powers of two, these are summed as longs, and the totals are put together once per group. With one, the column is
declared to have that many decimals; further ones are rounded away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"

LIMB_BITS = 21
LIMB_MASK = (1 << LIMB_BITS) - 1
SAFE_FACTOR = 3_037_000_499  # the largest whole number whose square fits a long


def fixed(col: Column, scale: int = 2) -> Column:
    """A number as a whole count of 10**-scale units."""
    return F.rint(col.cast("double") * F.lit(float(10**scale))).cast("long")


LEAST_POWER, MOST_POWER = -1022, 1023


def _two_to(power: Column) -> Column:
    """2**power, exact for whole powers."""
    return F.pow(F.lit(2.0), power.cast("double"))


def _power(size: Column, guess: Column) -> Column:
    """The exponent of a positive number, from one that may be off by one beside a power of two."""
    return (
        F.when(size < _two_to(guess), F.greatest(F.lit(LEAST_POWER), guess - 1))
        .when(size / 2 >= _two_to(guess), F.least(F.lit(MOST_POWER), guess + 1))
        .otherwise(guess)
    )


def _bits(x: Column, power: Column, share: Column) -> Column:
    """Exponent and fraction as they are stored; ``share`` is below 1 only for the numbers next to zero."""
    stored = F.when(share < 1, F.lit(0)).otherwise(power + 1023).cast("long") * F.lit(1 << 52)
    fraction = ((share - F.when(share < 1, 0.0).otherwise(1.0)) * F.lit(float(1 << 52))).cast("long")
    size = F.abs(x)
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(size == 0, F.lit(0)).otherwise(stored + fraction)
    return F.when(~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def with_sortable(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds a double as a long in the same order, one for each number: its stored exponent and fraction.

    Both zeros give 0. NaN and null give null. The steps are columns of their own, so that none is computed twice.
    """
    x = F.col(column)
    guess = F.greatest(F.lit(float(LEAST_POWER)), F.least(F.lit(float(MOST_POWER)), F.floor(F.log2(F.abs(x))).cast("double"))).cast("int")
    steps = df.withColumn("_s_power", guess).withColumn("_s_power", _power(F.abs(x), F.col("_s_power")))
    steps = steps.withColumn("_s_share", F.abs(x) / _two_to(F.col("_s_power")))
    return steps.withColumn(out, _bits(x, F.col("_s_power"), F.col("_s_share"))).drop("_s_power", "_s_share")


def from_sortable(bits: Column) -> Column:
    """The double of a long made by ``with_sortable``."""
    size = F.abs(bits)
    stored, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    small = fraction * F.pow(F.lit(2.0), F.lit(-1074.0))
    usual = (F.lit(1.0) + fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), (stored - 1023).cast("double"))
    value = F.when(stored == 0, small).when(stored == 2047, F.lit(float("inf"))).otherwise(usual)
    return F.when(bits < 0, -value).otherwise(value)


def exact_total(units: Column, limbs: int = 2) -> Column:
    """Sum of whole numbers as a decimal that cannot overflow at any realistic row count.

    Each number is split into pieces of 21 bits that are summed as plain longs,
    many times faster than adding decimals row by row, and put together once
    per group.
    """
    total = None
    for i in reversed(range(limbs)):
        piece = F.shiftright(units, i * LIMB_BITS) if i else units
        if i < limbs - 1:
            piece = piece.bitwiseAND(F.lit(LIMB_MASK))
        part = F.sum(piece).cast(WIDE)
        total = part if total is None else total * F.lit(1 << LIMB_BITS) + part
    return total.cast(WIDE)


def product_total(x: Column, y: Column) -> Column:
    """Sum of products of whole numbers.

    A product that might not fit a long is formed as a decimal; for ordinary
    magnitudes that branch is never taken.
    """
    small = (F.abs(x) <= F.lit(SAFE_FACTOR)) & (F.abs(y) <= F.lit(SAFE_FACTOR))
    large = x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    common = exact_total(F.when(small, x * y), limbs=3)
    rare = F.sum(F.when(~small, large.cast(WIDE)))
    return (F.coalesce(common, F.lit(0).cast(WIDE)) + F.coalesce(rare, F.lit(0)).cast(WIDE)).cast(WIDE)


PIECE_BITS = 24
SUM_POWERS = range(-108, 108, PIECE_BITS)
SQUARE_POWERS = range(-180, 156, PIECE_BITS)
SPLITTER = float((1 << 27) + 1)


def _pieces(x: Column, powers: range) -> list[Column]:
    """A double as whole numbers, one per power of two, that times those powers add up to it.

    Every step is exact: both terms are the number rounded to a power of two, and they differ by 24 bits at most.
    Bits below the least power are rounded away.
    """
    step = F.lit(float(1 << PIECE_BITS))
    rounded = [F.rint(x * F.lit(2.0**-power)) for power in [*powers, powers.stop]]
    return [(low - high * step).cast("long") for low, high in zip(rounded, rounded[1:])]


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _together(totals: Column, powers: range) -> Column:
    """The double that an array of totals of pieces stands for.

    Carries go up first, which leaves digits of both signs around zero, so that adding them from the least to the
    greatest loses nothing to cancellation. What each addition rounds away is kept and added at the end.
    """
    half, mask = 1 << (PIECE_BITS - 1), (1 << PIECE_BITS) - 1
    none = F.lit(0).cast("long")

    def add(so_far: Column, total: Column) -> Column:
        raised = total + so_far["carry"] + F.lit(half)
        digit = (raised.bitwiseAND(F.lit(mask)) - F.lit(half)).cast("double") * so_far["unit"]
        value = so_far["value"] + digit
        return F.struct(
            value.alias("value"),
            (so_far["lost"] + (so_far["value"] - (value - digit))).alias("lost"),
            F.shiftright(raised, PIECE_BITS).alias("carry"),
            (so_far["unit"] * F.lit(float(1 << PIECE_BITS))).alias("unit"),
        )

    start = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("lost"), none.alias("carry"), F.lit(2.0**powers.start).alias("unit"))
    return F.aggregate(F.concat(totals, F.array(none, none)), start, add, lambda end: end["value"] + end["lost"])


def _with_rest(totals: Column, powers: range) -> Column:
    """What totals of pieces stand for, as the nearest double and the double nearest to what is left."""
    def rest(near: Column) -> Column:
        left = F.zip_with(totals, F.array(*_pieces(near, powers)), lambda t, p: t - p)
        return F.struct(near.alias("near"), _together(left, powers).alias("rest"))

    return _with(_together(totals, powers), rest)


def _halves(x: Column) -> tuple[Column, Column]:
    """Two doubles of 26 bits that add up to ``x``; products of such are exact."""
    scaled = x * F.lit(SPLITTER)
    high = scaled - (scaled - x)
    return high, x - high


def _product(x: Column, y: Column) -> tuple[Column, Column]:
    """The product as a double and what rounding took from it."""
    (xh, xl), (yh, yl) = _halves(x), _halves(y)
    rounded = x * y
    return rounded, ((xh * yh - rounded) + xh * yl + xl * yh) + xl * yl


def _within(x: Column, least: float, most: float) -> Column:
    return (x == F.lit(0.0)) | ((F.abs(x) >= F.lit(least)) & (F.abs(x) < F.lit(most)))


def steady_sum(col: Column) -> Column:
    """Sum of doubles, rounded once, the same for every order and grouping of the rows; null without values.

    Holds for numbers between 2**-56 (1e-17) and 2**106 (1e31) in size, and for up to 2**39 rows a group. Other
    numbers, infinite ones and NaN are summed as doubles beside them.
    """
    x = col.cast("double")
    usual = _within(x, 2.0**-56, 2.0**106)
    totals = F.array(*[F.coalesce(F.sum(F.when(usual, p)), F.lit(0).cast("long")) for p in _pieces(x, SUM_POWERS)])
    rest = F.coalesce(F.sum(F.when(~usual, x)), F.lit(0.0))
    return F.when(F.count(x) > 0, _together(totals, SUM_POWERS) + rest)


def _steady_deviation(col: Column, ddof: int) -> Column:
    """Standard deviation from exact sums of the numbers and of their squares.

    Both sums are kept as two doubles, 106 bits, so that numbers that are large beside their spread keep it. A group
    with a number from 2**59 (5e17) in size, or one below 2**-56 (1e-17), takes the usual sums of doubles.
    """
    x = col.cast("double")
    usual = _within(x, 2.0**-56, 2.0**59)
    high, low = _halves(x)
    parts = zip(*[_pieces(part, SQUARE_POWERS) for part in (high * high, F.lit(2.0) * high * low, low * low)])

    def totals(pieces: list[Column]) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(usual, p)), F.lit(0).cast("long")) for p in pieces])

    sums = F.struct(
        F.count(x).cast("double").alias("n"),
        _with_rest(totals(_pieces(x, SUM_POWERS)), SUM_POWERS).alias("s"),
        _with_rest(totals([a + b + c for a, b, c in parts]), SQUARE_POWERS).alias("q"),
    )

    def deviation(v: Column) -> Column:
        n, s, q = v["n"], v["s"], v["q"]
        (nq, nq_rest), (ss, ss_rest) = _product(n, q["near"]), _product(s["near"], s["near"])
        small = (nq_rest - ss_rest) + (n * q["rest"] - F.lit(2.0) * s["near"] * s["rest"])
        pairs = F.nullif(n * (n - F.lit(float(ddof))), F.lit(0.0))
        return F.sqrt(F.greatest((nq - ss) + small, F.lit(0.0)) / pairs)

    plain = (F.stddev_samp if ddof else F.stddev_pop)(x)
    return F.when(F.count_if(~usual) > 0, plain).otherwise(_with(sums, deviation))


def exact_sum(col: Column, scale: int | None = None) -> Column:
    if scale is None:
        return steady_sum(col)
    return exact_total(fixed(col, scale)).cast("double") / F.lit(float(10**scale))


def exact_mean(col: Column, scale: int | None = None) -> Column:
    """Mean of the non-null values; null when there are none."""
    if scale is None:
        return steady_sum(col) / F.nullif(F.count(col.cast("double")).cast("double"), F.lit(0.0))
    n = F.count(col).cast("double")
    return exact_total(fixed(col, scale)).cast("double") / F.nullif(n * F.lit(float(10**scale)), F.lit(0.0))


def spread(n: Column, total: Column, squares: Column, scale: int, ddof: int) -> Column:
    """Standard deviation from a count, a sum and a sum of squares of fixed-point values."""
    wide = n.cast("decimal(19,0)") * squares.cast(WIDE) - total.cast("decimal(28,0)") * total.cast("decimal(28,0)")
    count = n.cast("double")
    pairs = F.nullif(count * (count - F.lit(float(ddof))), F.lit(0.0))
    return F.sqrt(wide.cast("double") / pairs) / F.lit(float(10**scale))


def _deviation(col: Column, scale: int, ddof: int) -> Column:
    units = fixed(col, scale)
    return spread(F.count(col), exact_total(units), product_total(units, units), scale, ddof)


def exact_std(col: Column, scale: int | None = None) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    if scale is None:
        return _steady_deviation(col, ddof=1)
    return _deviation(col, scale, ddof=1)


def exact_std_pop(col: Column, scale: int | None = None) -> Column:
    """Population standard deviation."""
    if scale is None:
        return _steady_deviation(col, ddof=0)
    return _deviation(col, scale, ddof=0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as doubles, null when ``b`` is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column, digits: int | None = None) -> Column:
    """``a`` as a percentage of ``b``, null when ``b`` is zero."""
    value = F.lit(100.0) * ratio(a, b)
    return value if digits is None else F.round(value, digits)
