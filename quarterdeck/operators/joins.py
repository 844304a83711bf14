"""Join shapes used by the feature tables.

Keys match by plain equality, so null keys never match. Whether a side is
broadcast is left to Spark, which checks its size at run time and falls back to
a sort-merge join with skewed partitions split; only calendar tables, bounded
by the number of quarters or days, carry an explicit hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_sum
from quarterdeck.functions.keys import present_flag
from quarterdeck.operators.rows import known, order_key


def lookup(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left") -> DataFrame:
    """Equi-join on differently named keys; the right-hand keys do not appear in the result."""
    renamed = right.withColumnsRenamed({r: f"_r_{r}" for r in keys.values()})
    condition = None
    for l, r in keys.items():
        test = left[l] == renamed[f"_r_{r}"]
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{r}" for r in keys.values()])


def with_dimension(fact: DataFrame, dimension: DataFrame, key: str | list[str]) -> DataFrame:
    """Left join of a table with one row per entity."""
    return fact.join(dimension, key, "left")


def with_calendar(fact: DataFrame, calendar: DataFrame, key: str = "quarter") -> DataFrame:
    """Left join of a table with one row per quarter.

    Such a table has four rows a year, so it is broadcast; shuffling the facts
    on a handful of quarters would leave most tasks without work.
    """
    return fact.join(F.broadcast(calendar), key, "left")


def overlay(left: DataFrame, right: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """Left join where the right side's value replaces the left's unless it is null."""
    fresh = right.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = left.join(fresh, keys, "left")
    merged = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(merged).select(*left.columns)


def cover(entities: DataFrame, features: DataFrame, key: str, policy: str = "keep") -> DataFrame:
    """Attach features; an entity without any is kept with nulls or dropped."""
    if policy not in ("keep", "drop"):
        raise ValueError("policy is 'keep' or 'drop'")
    return entities.join(features, key, "left" if policy == "keep" else "inner")


def unmatched(labels: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Label rows without a panel row."""
    return labels.join(panel.select(*keys).distinct(), keys, "left_anti")


def label_rows(
    labels: DataFrame,
    keys: list[str],
    policy: str,
    order: Sequence[str],
    flag: str,
    amount: str,
    firsts: Sequence[str] = (),
    scale: int | None = None,
    pending: bool = False,
) -> DataFrame:
    """Reduce label events to what one panel key receives.

    ``fanout`` keeps every event, so a key with two events gets two panel rows.
    ``first`` keeps the first event. ``total`` takes the events whose flag is
    known, with the first flag, the sum of the amounts and the first of any
    further columns. With ``pending`` it takes the other events too: their amounts
    count, and the flag is null only where none is known.
    """
    usable = known(labels, keys)
    wanted = [*keys, flag, amount, *firsts]
    if policy == "fanout":
        return usable.select(*wanted)
    at = order_key(order)
    if policy == "first":
        row = F.struct(flag, amount, *firsts)
        return usable.groupBy(*keys).agg(F.min_by(row, at).alias("_row")).select(*keys, "_row.*")
    if policy == "total":
        return (usable if pending else known(usable, [flag])).groupBy(*keys).agg(
            *[
                F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
                for c in (flag, *firsts)
            ],
            F.coalesce(exact_sum(F.col(amount), scale), F.lit(0.0)).alias(amount),
        )
    raise ValueError("policy is 'fanout', 'first' or 'total'")


def attach_labels(panel: DataFrame, rows: DataFrame, keys: list[str], flag: str, amount: str) -> DataFrame:
    """Left-join reduced label events; the amount becomes 0 and the flag stays null without one."""
    joined = panel.join(rows, keys, "left")
    return joined.withColumns(
        {amount: F.coalesce(F.col(amount), F.lit(0.0)), "has_promise": present_flag(F.col(flag))}
    )
