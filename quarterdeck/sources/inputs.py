"""The known input tables, read from landed CSV files.

Columns are found by name. Known ones are cast to their type, others stay
text, and no pass over the data is spent on guessing types.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import (
    COMPANIES,
    DEMOGRAPHIC_COUNTS,
    MACRO_LAST,
    MACRO_MEAN,
    RATIO_COLUMNS,
    RECOMMENDATIONS,
    TARGETS,
)
from quarterdeck.functions.keys import parse_ts, parse_ts_lenient, recode
from quarterdeck.sources.files import raw_csv, raw_csv_tagged

PRICE_TYPES = dict.fromkeys(["Open", "High", "Low", "Close", "Volume"], "double")
RATIO_TYPES = dict.fromkeys(RATIO_COLUMNS, "double")
MACRO_TYPES = dict.fromkeys([*MACRO_LAST, *MACRO_MEAN], "double")
PROMISE_TYPES = {
    "promised_mw": "double",
    "days_to_target": "double",
    "promise_kept": "double",
    "median_income": "double",
    "median_home_value": "double",
}
DEMOGRAPHIC_TYPES = {
    **dict.fromkeys(DEMOGRAPHIC_COUNTS, "long"), "unemployment_rate": "double", "pct_bachelors": "double",
}
RECOMMENDATION_TYPES = dict.fromkeys(RECOMMENDATIONS, "long")
TARGET_TYPES = dict.fromkeys(TARGETS, "double")


def read_named(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str],
    stamps: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """CSV with a header; known columns cast by name, timestamps parsed by the given functions.

    A written-out NaN counts as missing.
    """
    return _typed(raw_csv(spark, path), types, stamps)


def _typed(
    raw: DataFrame, types: Mapping[str, str], stamps: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    typed = {c: F.nullif(F.col(c), F.lit("NaN")).cast(t) for c, t in types.items() if c in raw.columns}
    parsed = {c: parse(F.col(c)) for c, parse in (stamps or {}).items() if c in raw.columns}
    return raw.withColumns({**typed, **parsed})


def prices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, PRICE_TYPES, {"Date": parse_ts})


def prices_by_ticker(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Price files landed one per ticker, stacked and marked with ticker and company name; one scan for all."""
    stacked = _typed(raw_csv_tagged(spark, paths, "ticker"), PRICE_TYPES, {"Date": parse_ts})
    named = recode(F.col("ticker"), COMPANIES)
    return stacked.withColumn("company_name", named)


def ratios(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, RATIO_TYPES)


def macro(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, MACRO_TYPES, {"date": parse_ts})


def queue(spark: SparkSession, path: str | list[str], lenient: bool = True) -> DataFrame:
    """Queue dates are often unset or free text; ``lenient`` reads those as null."""
    return read_named(spark, path, {}, {"Queue Date": parse_ts_lenient if lenient else parse_ts})


def promises(spark: SparkSession, path: str | list[str], lenient: bool = True) -> DataFrame:
    parse = parse_ts_lenient if lenient else parse_ts
    loaded = read_named(spark, path, PROMISE_TYPES, {"announcement_date": parse, "target_date": parse})
    return loaded.withColumn("promise_kept", F.col("promise_kept").cast("int"))


def demographics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, DEMOGRAPHIC_TYPES)


def recommendations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, RECOMMENDATION_TYPES)


def targets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_named(spark, path, TARGET_TYPES)
