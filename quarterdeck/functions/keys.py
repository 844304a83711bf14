"""Quarter keys, timestamp parsing, code maps and the dates derived from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_key(ts: Column) -> Column:
    """Text key such as ``2021Q1``; null in, null out."""
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def quarter_start(ts: Column) -> Column:
    return F.trunc(ts, "quarter").cast("timestamp_ntz")


def quarter_index(ts: Column) -> Column:
    """Quarters since year 0, so that neighbours differ by one."""
    return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month").cast("timestamp_ntz")


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def parse_ts(text: Column) -> Column:
    """ISO text, date-only or with an offset, as a naive timestamp. Junk raises.

    The session zone must be UTC, so that an offset is turned into UTC and a
    text without one is read as UTC.
    """
    return text.cast("timestamp").cast("timestamp_ntz")


def parse_ts_lenient(text: Column) -> Column:
    """As ``parse_ts``, but junk becomes null."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def parse_ts_mixed(text: Column, formats: Iterable[str]) -> Column:
    """As ``parse_ts_lenient``, trying further date patterns in turn on texts that are not ISO."""
    tried = [text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in formats]]
    return F.coalesce(*tried).cast("timestamp_ntz")


def strip_prefix(col: Column, prefix: str) -> Column:
    """Every occurrence of a literal removed."""
    return F.replace(col, F.lit(prefix), F.lit(""))


def recode(col: Column, mapping: Mapping) -> Column:
    """Look up in a fixed table; a key it lacks gives null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.when(col.isNotNull(), F.try_element_at(pairs, col))


def recode_pair(col: Column, mapping: Mapping[str, tuple[str, str]], names: tuple[str, str]) -> Column:
    """Look up a pair of codes, returned as a struct with the given field names."""
    pairs = F.create_map(
        *chain.from_iterable(
            (F.lit(key), F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])))
            for key, (a, b) in mapping.items()
        )
    )
    return F.when(col.isNotNull(), F.try_element_at(pairs, col))


def member_flag(col: Column, members: Iterable) -> Column:
    return F.coalesce(col.isin(list(members)), F.lit(False))


def present_flag(col: Column) -> Column:
    return col.isNotNull().cast("int")


def repair_shift(col: Column, fallback: Column, foreign: Iterable) -> Column:
    """Take ``fallback`` on rows where ``col`` holds a value of another column.

    The decision is made per row, so well-formed rows keep their own value.
    """
    return F.when(col.isin(list(foreign)), fallback).otherwise(col)


def months_apart(start: Column, end: Column) -> Column:
    """Calendar months from one date to another, days ignored."""
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("long")


def days_apart(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")


def in_season(ts: Column, first: int = 2, last: int = 3) -> Column:
    """1 in the building season, quarters two and three."""
    return F.quarter(ts).between(first, last).cast("int")


def fiscal_quarter(ts: Column, first_month: int = 10) -> Column:
    """Quarter number of a fiscal year that starts in ``first_month``."""
    return (F.floor(F.pmod(F.month(ts) - F.lit(first_month), F.lit(12)) / 3) + 1).cast("int")


def bucket(col: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first lower bound the value exceeds; bounds in descending order."""
    chosen = None
    for floor_value, label in bounds:
        test = col > F.lit(floor_value)
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return F.when(col.isNotNull(), chosen.otherwise(otherwise))
