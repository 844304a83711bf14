import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import exact, fixed_values, keys, text


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def stamp(t):
    return F.lit(t).cast("timestamp_ntz")


def test_quarter_key(spark):
    assert one(spark, keys.quarter_key(stamp("2021-03-31 23:59:59"))) == "2021Q1"
    assert one(spark, keys.quarter_key(F.lit(None).cast("timestamp_ntz"))) is None
    assert one(spark, keys.quarter_start(stamp("2021-08-15"))) == dt.datetime(2021, 7, 1)
    assert one(spark, keys.quarter_index(stamp("2022-01-01")) - keys.quarter_index(stamp("2021-12-31"))) == 1


@pytest.mark.parametrize(
    "written, naive",
    [
        ("2021-01-05", dt.datetime(2021, 1, 5)),
        ("2021-01-05T10:00:00", dt.datetime(2021, 1, 5, 10)),
        ("2021-01-05 00:00:00-05:00", dt.datetime(2021, 1, 5, 5)),
        ("2021-01-05T10:00:00+05:30", dt.datetime(2021, 1, 5, 4, 30)),
        (None, None),
    ],
)
def test_parse_ts(spark, written, naive):
    assert one(spark, keys.parse_ts(F.lit(written))) == naive
    assert one(spark, keys.parse_ts_lenient(F.lit(written))) == naive


def test_mixed_patterns(spark):
    parse = lambda t: one(spark, keys.parse_ts_mixed(F.lit(t), ["MM/dd/yyyy", "d MMM yyyy"]))
    assert parse("01/31/2021") == dt.datetime(2021, 1, 31)
    assert parse("5 Feb 2021") == dt.datetime(2021, 2, 5)
    assert parse("2021-03-04T05:06:07Z") == dt.datetime(2021, 3, 4, 5, 6, 7)
    assert parse("soon") is None


def test_junk_timestamps(spark):
    assert one(spark, keys.parse_ts_lenient(F.lit("TBD"))) is None
    df = spark.createDataFrame([("TBD",)], ["t"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(keys.parse_ts(F.col("t"))).collect()


def test_recode(spark, rows):
    df = spark.createDataFrame([("TICKER_MSFT",), ("TICKER_XYZ",), (None,)], "c string")
    assert rows(df.select(keys.recode(F.col("c"), fixed_values.TICKER_MAP))) == [(None,), (None,), ("MSFT",)]
    pair = keys.recode_pair(F.lit("Phoenix, AZ"), fixed_values.PLACE_CODES, ("state", "county"))
    assert tuple(one(spark, pair)) == ("04", "013")


def test_repair_is_per_row(spark, rows):
    df = spark.createDataFrame([("CAISO", "DLR"), ("MSFT", "TIER_1")], "a string, b string")
    assert rows(df.select(keys.repair_shift(F.col("a"), F.col("b"), ["CAISO"]))) == [("DLR",), ("MSFT",)]


def test_member_flag(spark):
    assert one(spark, keys.member_flag(F.lit("Texas"), fixed_values.US_JURISDICTIONS)) is True
    assert one(spark, keys.member_flag(F.lit("Puerto Rico"), fixed_values.US_JURISDICTIONS)) is False
    assert one(spark, keys.member_flag(F.lit(None).cast("string"), ["a"])) is False


def test_dates(spark):
    start, end = stamp("2021-11-30"), stamp("2022-02-01")
    assert one(spark, keys.months_apart(start, end)) == 3
    assert one(spark, keys.days_apart(start, end)) == 63
    assert one(spark, keys.in_season(start)) == 0
    assert [one(spark, keys.fiscal_quarter(stamp(f"2021-{m:02d}-01"))) for m in (10, 12, 1, 4, 9)] == [1, 1, 2, 3, 4]


def test_bucket(spark):
    tier = lambda v: one(spark, keys.bucket(F.lit(v).cast("double"), fixed_values.TIER_BOUNDS, "TIER_4"))
    assert [tier(v) for v in (2e12, 100e9, 5e9, 1e8, None)] == ["TIER_1", "TIER_2", "TIER_3", "TIER_4", None]


def test_exact_aggregates(spark):
    values = [0.1, 0.2, -0.3, 12.34, -99.99, None, 1e6]
    known = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    mean, std, pop, total = df.agg(
        exact.exact_mean(F.col("v")), exact.exact_std(F.col("v")), exact.exact_std_pop(F.col("v")), exact.exact_sum(F.col("v"))
    ).first()
    assert total == round(sum(known), 2)
    assert math.isclose(mean, statistics.mean(known), rel_tol=1e-15)
    assert math.isclose(std, statistics.stdev(known), rel_tol=1e-12)
    assert math.isclose(pop, statistics.pstdev(known), rel_tol=1e-12)


def test_exact_edges(spark):
    df = spark.createDataFrame([(1.0, None)], "one double, none double")
    row = df.agg(
        exact.exact_std(F.col("one")), exact.exact_std_pop(F.col("one")), exact.exact_mean(F.col("none")), exact.exact_sum(F.col("none"))
    ).first()
    assert tuple(row) == (None, 0.0, None, None)


def test_exact_total_beyond_long(spark):
    big = 2**62 - 12345
    df = spark.createDataFrame([(big,)] * 7 + [(-3,)], "v long")
    assert int(df.agg(exact.exact_total(F.col("v"), limbs=3)).first()[0]) == 7 * big - 3
    assert int(df.agg(exact.exact_total(F.col("v"), limbs=2)).first()[0]) == 7 * big - 3


def test_products_beyond_long(spark):
    big = 200_000_000_000_000
    df = spark.createDataFrame([(big,), (-big,), (3,), (None,)], "v long")
    assert int(df.agg(exact.product_total(F.col("v"), F.col("v"))).first()[0]) == 2 * big * big + 9
    caps = spark.createDataFrame([(2e12,), (3e12,), (1e12,)], "v double")
    assert caps.agg(exact.exact_std(F.col("v"))).first()[0] == 1e12


def test_ratio_and_percent(spark):
    assert one(spark, exact.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, exact.percent(F.lit(1), F.lit(3), 2)) == 33.33


def test_regex_hits(spark):
    body = F.lit("A 1,200 MW site, then 50MW and 300 Megawatts; 7 MW is too short")
    assert one(spark, text.regex_hits(body, fixed_values.POWER_PATTERN)) == ["1,200 MW", "50MW", "300 Megawatt"]
    assert one(spark, text.regex_hits(F.lit(None).cast("string"), "x")) == []
    assert one(spark, text.section_hits([F.lit("10 MW"), F.lit(None).cast("string"), F.lit("20 MW")], fixed_values.POWER_PATTERN)) == [
        "10 MW", "20 MW",
    ]


def test_term_counts_cover_the_whole_text(spark):
    long_text = "x" * 60_000 + " Data Center data center"
    assert one(spark, text.term_count(F.lit(long_text), "data center")) == 2
    assert one(spark, text.term_count(F.lit("aaaa"), "aa")) == 2
    assert one(spark, text.term_count(F.lit(None).cast("string"), "aa")) == 0


def test_keyword_breadth(spark):
    body = F.lit("Sites in Europe, europe, India and the United Kingdom")
    assert one(spark, text.keyword_breadth(body, fixed_values.GLOBAL_KEYWORDS)) == 3


@pytest.mark.parametrize("stored, n", [("['10 MW', '2,000 MW']", 2), ("[]", 0), (None, 0), ("oops", 0), ("['a'", 0)])
def test_stored_list_len(spark, stored, n):
    df = spark.createDataFrame([(stored,)], "t string")
    assert df.select(text.stored_list_len(F.col("t"))).first()[0] == n


@pytest.mark.parametrize("stored, n", [
    ("[" + ", ".join(["'10,5'"] * 50_000) + "]", 50_000),
    ("['" + "x" * 300_000 + "', \"" + "y" * 300_000 + "\"]", 2),
    ("[" + ", ".join(["1"] * 50_000) + ", 'a]", 0),
    ("[" + " " * 300_000 + "'", 0),
])
def test_stored_list_len_of_long_lists(spark, stored, n):
    """Neither many items nor long ones use up the stack."""
    df = spark.createDataFrame([(stored,)], "t string")
    assert df.select(text.stored_list_len(F.col("t"))).first()[0] == n
