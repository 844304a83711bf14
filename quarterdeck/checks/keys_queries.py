"""Keys, casts, code maps and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import table
from quarterdeck.functions import keys
from quarterdeck.functions.exact import exact_sum, percent
from quarterdeck.operators.rollup import rate_by, weighted_mean
from quarterdeck.operators.split import one_hot
from quarterdeck.plans.promises import with_timing

HIGH = {"1-URGENT": "HIGH", "2-HIGH": "HIGH", "3-MEDIUM": "MID"}


@query(
    "quarter_key",
    """SELECT o_orderkey, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter,
       year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter_num FROM orders""",
)
def quarter_key(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        keys.quarter_key(day).alias("quarter"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter_num"),
    )


@query(
    "parse_ts",
    """SELECT event_id,
       CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts)
            WHEN 1 THEN date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE
            WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP END AS lenient,
       CASE event_id % 4 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE
            WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS strict
       FROM events""",
)
def parse_ts(spark, d):
    events = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    good = F.when(kind == 1, F.concat(stamp, F.lit("+05:30"))).when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
    return events.select(
        "event_id",
        keys.parse_ts_lenient(F.when(kind == 3, F.lit("pending")).otherwise(good.otherwise(stamp))).alias("lenient"),
        keys.parse_ts(good.otherwise(stamp)).alias("strict"),
    )


@query(
    "strip_prefix",
    "SELECT c_custkey, replace(c_name, 'Customer#', '') AS code, upper(c_mktsegment) AS segment FROM customer",
)
def strip_prefix(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        keys.strip_prefix(F.col("c_name"), "Customer#").alias("code"),
        F.upper("c_mktsegment").alias("segment"),
    )


@query(
    "recode_map",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH'
       WHEN '3-MEDIUM' THEN 'MID' END AS urgency,
       CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '02' END AS state_code,
       CASE o_orderstatus WHEN 'F' THEN '001' WHEN 'O' THEN '013' END AS county_code FROM orders""",
)
def recode_map(spark, d):
    pair = keys.recode_pair(F.col("o_orderstatus"), {"F": ("01", "001"), "O": ("02", "013")}, ("state", "county"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        keys.recode(F.col("o_orderpriority"), HIGH).alias("urgency"),
        pair["state"].alias("state_code"),
        pair["county"].alias("county_code"),
    )


@query(
    "member_flag",
    """SELECT n_nationkey, n_name IN ('NATION_1', 'NATION_5', 'NATION_7') AS is_member,
       c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def member_flag(spark, d):
    # The nation table has a fixed number of rows at every scale.
    nation = F.broadcast(table(spark, d, "nation"))
    joined = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "n_nationkey",
        keys.member_flag(F.col("n_name"), ["NATION_1", "NATION_5", "NATION_7"]).alias("is_member"),
        "c_custkey",
    )


@query(
    "repair_shift",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey::VARCHAR
       ELSE o_custkey::VARCHAR END AS ticker_clean FROM orders""",
)
def repair_shift(spark, d):
    # Rows of one priority are shifted: the region sits where the ticker belongs.
    code = F.concat(F.lit("TICKER_"), F.col("o_custkey").cast("string"))
    shifted = F.col("o_orderpriority") == "5-LOW"
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(shifted, F.lit("CAISO")).otherwise(code).alias("company_ticker"),
        F.when(shifted, code).otherwise(F.lit("TIER_1")).alias("company_tier"),
    )
    repaired = keys.repair_shift(
        keys.strip_prefix(F.col("company_ticker"), "TICKER_"),
        keys.strip_prefix(F.col("company_tier"), "TICKER_"),
        ["CAISO", "ERCOT"],
    )
    return rows.select("o_orderkey", repaired.alias("ticker_clean"))


@query(
    "temporal_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, quarter(o_orderdate)::INT AS announced_quarter,
       month(o_orderdate)::INT AS announced_month, (dayofweek(o_orderdate) + 1)::INT AS announced_weekday,
       datediff('day', o_orderdate, l_shipdate) AS days_to_target,
       datediff('month', o_orderdate, l_shipdate) AS months_to_target,
       CASE WHEN quarter(o_orderdate) IN (2, 3) THEN 1 ELSE 0 END AS in_season,
       CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE (month(o_orderdate) + 2) // 3 + 1 END::INT AS fiscal_quarter
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def temporal_features(spark, d):
    # Line items as promises: announced with the order, due on the ship date.
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    dated = lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.col("o_orderdate").alias("announcement_date"),
        F.col("l_shipdate").alias("target_date"),
    )
    return with_timing(dated).drop("announcement_date", "target_date")


@query(
    "timeline_adherence",
    """SELECT o_orderkey, o_orderdate AS target_date, max(l_shipdate) AS actual_date,
       datediff('day', o_orderdate, max(l_shipdate)) AS days_late
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def timeline_adherence(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("actual_date")
    )
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("target_date"))
    return rows.join(done, "o_orderkey", "left").withColumn(
        "days_late", keys.days_apart(F.col("target_date"), F.col("actual_date"))
    )


@query(
    "capacity_pct",
    """WITH done AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 AS delivered
       FROM lineitem GROUP BY 1)
       SELECT o_orderkey, o_totalprice AS promised, delivered,
       100 * (delivered / nullif(o_totalprice, 0)) AS capacity_pct
       FROM orders LEFT JOIN done ON l_orderkey = o_orderkey""",
)
def capacity_pct(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        exact_sum(F.col("l_extendedprice"), 2).alias("delivered")
    )
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("promised"))
    return rows.join(done, "o_orderkey", "left").withColumn(
        "capacity_pct", percent(F.col("delivered"), F.col("promised"))
    )


@query(
    "pct_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       100 * (l_quantity / nullif(l_linenumber - 1, 0)) AS pct,
       100 * ((l_extendedprice - l_quantity) / nullif(l_quantity, 0)) AS surprise_pct FROM lineitem""",
)
def pct_ratio(spark, d):
    actual, expected = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        percent(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("pct"),
        percent(actual - expected, expected).alias("surprise_pct"),
    )


TIERS = [(7500.0, "TIER_1"), (5000.0, "TIER_2"), (2500.0, "TIER_3")]
TIER_SQL = """CASE WHEN c_acctbal > 7500 THEN 'TIER_1' WHEN c_acctbal > 5000 THEN 'TIER_2'
              WHEN c_acctbal > 2500 THEN 'TIER_3' ELSE 'TIER_4' END"""


def _tiers(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", keys.bucket(F.col("c_acctbal"), TIERS, "TIER_4").alias("tier")
    )


@query("tier_bucket", f"SELECT c_custkey, {TIER_SQL} AS tier FROM customer")
def tier_bucket(spark, d):
    return _tiers(spark, d).select("c_custkey", "tier")


@query(
    "one_hot",
    f"""SELECT c_custkey, (tier = 'TIER_1')::INT AS tier_TIER_1, (tier = 'TIER_2')::INT AS tier_TIER_2,
       (tier = 'TIER_3')::INT AS tier_TIER_3, (tier = 'TIER_4')::INT AS tier_TIER_4
       FROM (SELECT c_custkey, {TIER_SQL} AS tier FROM customer)""",
)
def one_hot_tier(spark, d):
    names = ["TIER_1", "TIER_2", "TIER_3", "TIER_4"]
    return one_hot(_tiers(spark, d), "tier", names).select("c_custkey", *[f"tier_{t}" for t in names])


@query(
    "rate_by_group",
    f"""WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS kept FROM orders),
       c AS (SELECT c_custkey, c_nationkey, {TIER_SQL} AS tier FROM customer)
       SELECT tier, r_name, count(*) AS n, sum(kept)::DOUBLE / count(*) AS success_rate,
       (count(*) - sum(kept))::DOUBLE / count(*) AS failure_rate
       FROM o JOIN c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE kept IS NOT NULL GROUP BY ALL""",
)
def rate_by_group(spark, d):
    kept = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    orders = table(spark, d, "orders").select("o_custkey", kept.alias("kept"))
    # Counts per customer first, so the joins see one row per customer.
    per_customer = orders.filter("kept IS NOT NULL").groupBy("o_custkey", "kept").agg(F.count(F.lit(1)).alias("n"))
    # Nation and region have a fixed number of rows at every scale.
    places = table(spark, d, "nation").join(
        F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = per_customer.join(_tiers(spark, d), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")
    )
    hits = F.sum(F.col("n") * F.col("kept"))
    return joined.groupBy("tier", "r_name").agg(
        F.sum("n").alias("n"),
        (hits.cast("double") / F.sum("n").cast("double")).alias("success_rate"),
        ((F.sum("n") - hits).cast("double") / F.sum("n").cast("double")).alias("failure_rate"),
    )


@query(
    "rate_by_priority",
    """SELECT o_orderpriority, count(*) AS n,
       count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS success_rate,
       count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / count(*) AS failure_rate
       FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
)
def rate_by_priority(spark, d):
    kept = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return rate_by(table(spark, d, "orders").withColumn("kept", kept), ["o_orderpriority"], "kept")


@query(
    "weighted_mean",
    """SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)::HUGEINT * l_quantity::BIGINT)::DOUBLE
       / nullif(sum(l_quantity::BIGINT)::DOUBLE * 100, 0) AS weighted_mean FROM lineitem GROUP BY 1""",
)
def weighted_mean_price(spark, d):
    return weighted_mean(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 2)
