"""The test tables in the roles of price, macro, queue, promise and ratio tables.

``prices`` are orders by customer, ``queue`` and ``macro`` come from line items,
``promises`` are orders again, ``ratios`` are customers. The SQL twins below
define the same tables for the counterpart queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.exact import exact_sum, fixed
from quarterdeck.functions.keys import month_start, recode

REGIONS = ["A", "N", "R"]
REGION_OF_PRIORITY = {"1-URGENT": "A", "2-HIGH": "n", "3-MEDIUM": "R", "4-NOT SPECIFIED": "a"}
TIER_OF_PRIORITY = {"1-URGENT": "TIER_1", "2-HIGH": "TIER_2", "3-MEDIUM": "TIER_3", "4-NOT SPECIFIED": "TIER_4"}


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, read with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("ticker"),
        F.col("o_orderdate").alias("Date"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("Close"),
    )


def traded(spark: SparkSession, folder: str) -> DataFrame:
    """Prices with volume, high and low from the lines of each order."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("Volume"),
        F.max("l_extendedprice").alias("High"),
        F.min("l_extendedprice").alias("Low"),
    )
    return prices(spark, folder).join(lines, "row_id", "left").withColumn("Open", F.col("Low"))


def macro(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly indicators; output is missing in every second month of a quarter."""
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy(month_start(F.col("l_shipdate")).alias("date"))
        .agg(
            exact_sum(F.col("l_extendedprice"), 2).alias("gdp"),
            F.max(fixed(F.col("l_extendedprice"))).alias("cpi"),
            exact_sum(F.col("l_discount"), 2).alias("Fed Funds Rate"),
            exact_sum(F.col("l_tax"), 2).alias("Unemployment Rate"),
            exact_sum(F.col("l_quantity"), 2).alias("30Y Mortgage Rate"),
            F.count(F.lit(1)).cast("double").alias("10Y Treasury"),
        )
    )
    second = F.month("date") % 3 == 2
    return monthly.select(
        "date",
        F.when(~second, F.col("gdp")).alias("Real GDP"),
        F.when(F.month("date") != 12, F.col("cpi").cast("double") / F.lit(100.0)).alias("Core CPI"),
        "Fed Funds Rate",
        "Unemployment Rate",
        "30Y Mortgage Rate",
        "10Y Treasury",
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """Region names in mixed letter case."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", F.lower(flag)).otherwise(flag).alias("iso"),
        F.col("l_shipdate").alias("Queue Date"),
    )


def promises(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as promises: kept when F, broken when O, unknown when P."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("TICKER_"), F.col("o_custkey").cast("string")).alias("company_ticker"),
        recode(F.col("o_orderpriority"), TIER_OF_PRIORITY).alias("company_tier"),
        recode(F.col("o_orderpriority"), REGION_OF_PRIORITY).alias("iso"),
        F.col("o_orderdate").alias("announcement_date"),
        F.expr("timestampadd(DAY, cast(o_orderkey % 400 as int), o_orderdate)").alias("target_date"),
        F.col("o_totalprice").alias("promised_mw"),
        F.when(status == "F", 1).when(status == "O", 0).alias("promise_kept"),
        F.col("o_orderkey").alias("promise_id"),
    )


def promise_ticker():
    """Ticker of a promise in the type of the price table's key."""
    return F.replace(F.col("company_ticker"), F.lit("TICKER_"), F.lit("")).cast("long")


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as companies; every third has no margin."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ticker"),
        F.col("c_acctbal").alias("market_cap"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / F.lit(100.0)).alias("profit_margin"),
        F.col("c_nationkey").cast("double").alias("beta"),
    )


# SQL twins. Numbers with two decimals are summed as whole hundredths.


def units(x: str, scale: int = 2) -> str:
    return f"CAST(round_even({x} * {10**scale}, 0) AS BIGINT)"


def mean(x: str, scale: int = 2) -> str:
    return f"(sum({units(x, scale)})::DOUBLE / nullif(count({x})::DOUBLE * {10**scale}, 0))"


def total(x: str, scale: int = 2) -> str:
    return f"(sum({units(x, scale)})::DOUBLE / {10**scale})"


def std(x: str, scale: int = 2, ddof: int = 1) -> str:
    u = units(x, scale)
    n = f"count({x})"
    spread = f"({n} * sum({u}::HUGEINT * {u}) - sum({u}) * sum({u}))"
    return f"(sqrt({spread}::DOUBLE / nullif({n}::DOUBLE * ({n}::DOUBLE - {ddof}), 0)) / {10**scale})"


def quarter(d: str) -> str:
    return f"(year({d})::VARCHAR || 'Q' || quarter({d})::VARCHAR)"


CTES = {
    "prices": """SELECT o_custkey AS ticker, o_orderdate AS "Date", o_orderkey AS row_id,
        o_totalprice AS "Close" FROM orders""",
    "traded": """SELECT p.*, v."Volume", v."High", v."Low", v."Low" AS "Open" FROM prices p LEFT JOIN (
        SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS "Volume", max(l_extendedprice) AS "High",
               min(l_extendedprice) AS "Low" FROM lineitem GROUP BY 1) v ON v.l_orderkey = p.row_id""",
    "macro": f"""SELECT m AS date, CASE WHEN month(m) % 3 <> 2 THEN gdp END AS "Real GDP",
        CASE WHEN month(m) <> 12 THEN cpi::DOUBLE / 100 END AS "Core CPI", fed AS "Fed Funds Rate",
        une AS "Unemployment Rate", mor AS "30Y Mortgage Rate", tre AS "10Y Treasury"
        FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS m, {total('l_extendedprice')} AS gdp,
              max({units('l_extendedprice')}) AS cpi, {total('l_discount')} AS fed, {total('l_tax')} AS une,
              {total('l_quantity')} AS mor, count(*)::DOUBLE AS tre FROM lineitem GROUP BY 1)""",
    "queue": """SELECT CASE WHEN l_linestatus = 'O' THEN lower(l_returnflag) ELSE l_returnflag END AS iso,
        l_shipdate AS "Queue Date" FROM lineitem""",
    "promises": """SELECT 'TICKER_' || o_custkey AS company_ticker, o_custkey AS ticker,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'TIER_1' WHEN '2-HIGH' THEN 'TIER_2'
             WHEN '3-MEDIUM' THEN 'TIER_3' WHEN '4-NOT SPECIFIED' THEN 'TIER_4' END AS company_tier,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'n' WHEN '3-MEDIUM' THEN 'R'
             WHEN '4-NOT SPECIFIED' THEN 'a' END AS iso,
        o_orderdate AS announcement_date, o_orderdate + to_days((o_orderkey % 400)::INT) AS target_date,
        o_totalprice AS promised_mw,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS promise_kept, o_orderkey AS promise_id
        FROM orders""",
    "ratios": """SELECT c_custkey AS ticker, c_acctbal AS market_cap,
        CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 100 END AS profit_margin,
        c_nationkey::DOUBLE AS beta FROM customer""",
    "fin": f"""SELECT ticker, {quarter('"Date"')} AS quarter, {mean('"Close"')} AS q_avg_close,
        coalesce({std('"Close"')}, 0) AS q_volatility, min("Close") AS q_min_close, max("Close") AS q_max_close,
        {mean('"Volume"', 0)} AS q_avg_volume, {total('"Volume"', 0)} AS q_total_volume,
        {mean('"Open"')} AS q_avg_open, {mean('"High"')} AS q_avg_high, {mean('"Low"')} AS q_avg_low
        FROM traded GROUP BY ALL""",
    "spine": f"""SELECT t.ticker, q.quarter FROM (SELECT DISTINCT ticker FROM prices) t,
        (SELECT DISTINCT {quarter('"Date"')} AS quarter FROM prices) q""",
    "macro_q": f"""SELECT {quarter('date')} AS quarter,
        arg_max("Real GDP", date) FILTER (WHERE "Real GDP" IS NOT NULL) AS "Real GDP",
        arg_max("Core CPI", date) FILTER (WHERE "Core CPI" IS NOT NULL) AS "Core CPI",
        {mean('"Fed Funds Rate"')} AS "Fed Funds Rate", {mean('"Unemployment Rate"')} AS "Unemployment Rate",
        {mean('"30Y Mortgage Rate"')} AS "30Y Mortgage Rate", {mean('"10Y Treasury"')} AS "10Y Treasury"
        FROM macro GROUP BY 1""",
    "macro_f": """SELECT quarter, """
    + ", ".join(
        f'last_value("{c}" IGNORE NULLS) OVER (ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"'
        for c in ["Real GDP", "Core CPI", "Fed Funds Rate", "Unemployment Rate", "30Y Mortgage Rate", "10Y Treasury"]
    )
    + " FROM macro_q",
    "depth": f"""SELECT upper(iso) AS iso, {quarter('"Queue Date"')} AS quarter, count(*) AS iso_queue_depth
        FROM queue GROUP BY ALL""",
    "wide": "SELECT quarter, "
    + ", ".join(f"coalesce(sum(iso_queue_depth) FILTER (WHERE iso = '{r}'), 0)::BIGINT AS queue_{r}" for r in REGIONS)
    + " FROM depth GROUP BY 1",
    "events_q": f"SELECT *, {quarter('target_date')} AS quarter FROM promises",
    "labels_total": f"""SELECT ticker, quarter, arg_min(promise_kept, (announcement_date, promise_id)) AS promise_kept,
        {total('promised_mw')} AS promised_mw FROM events_q WHERE promise_kept IS NOT NULL GROUP BY ALL""",
    "labels_one": """SELECT ticker, quarter, promise_kept, promised_mw FROM (SELECT *, row_number() OVER (
        PARTITION BY ticker, quarter ORDER BY announcement_date, promise_id) AS rn FROM events_q) WHERE rn = 1""",
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named tables."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n"
