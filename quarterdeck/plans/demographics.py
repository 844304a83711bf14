"""County and state demographics from array-of-arrays payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.exact import percent
from quarterdeck.functions.fixed_values import DEMOGRAPHIC_COUNTS, PLACE_CODES, STATE_ABBREVIATIONS
from quarterdeck.functions.keys import recode, recode_pair
from quarterdeck.sources.payloads import json_rows


def with_rates(df: DataFrame) -> DataFrame:
    workers = F.col("workers_16plus")
    return df.withColumns(
        {
            "unemployment_rate": percent(F.col("unemployed"), workers, 2),
            "pct_bachelors": percent(F.col("bachelors_degree"), workers, 2),
        }
    )


def counties(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per location; a payload without a data row is skipped."""
    fields = {"county_name": "string", **{c: "long" for c in DEMOGRAPHIC_COUNTS}}
    return with_rates(json_rows(payloads, body, ["location"], fields))


def states(payloads: DataFrame, body: str = "body") -> DataFrame:
    """All rows of a state payload, with the state's abbreviation first."""
    fields = {"state_name": "string", **{c: "long" for c in DEMOGRAPHIC_COUNTS}}
    rows = with_rates(json_rows(payloads, body, [], fields))
    return rows.select(recode(F.col("state_name"), STATE_ABBREVIATIONS).alias("state_abbr"), "*")


def place_codes(df: DataFrame, location: str) -> DataFrame:
    """State and county code of each known location, null for others."""
    return df.withColumn("_c", recode_pair(F.col(location), PLACE_CODES, ("state", "county"))).select(
        *df.columns, F.col("_c.state").alias("state_code"), F.col("_c.county").alias("county_code")
    )
