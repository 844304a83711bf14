"""Selection over double bits, as-of joins inside the day, ranks over ranges."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.exact import from_sortable, with_sortable
from quarterdeck.operators import asof, fill, ranges

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072009e-308, 2.2250738585072014e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2),
         math.nextafter(8, 0), 8.0, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1e-300, 3e300]


def test_sortable_keeps_order_and_value(spark):
    draw = random.Random(4)
    drawn = [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(3000)]
    powers = [math.nextafter(2.0**e, to) for e in range(-1073, 1024, 7) for to in (0, math.inf)]
    values = sorted(x for x in [*EDGES, *drawn, *powers] if x == x)
    rows = with_sortable(spark.createDataFrame([(x,) for x in values], "x double"), "x", "k")
    out = rows.withColumn("y", from_sortable(F.col("k"))).collect()
    out.sort(key=lambda r: r["x"])
    assert all(r["x"] == r["y"] for r in out)
    assert all((a["k"] < b["k"]) == (a["x"] < b["x"]) for a, b in zip(out, out[1:]))
    odd = with_sortable(spark.createDataFrame([(math.nan,), (None,)], "x double"), "x", "k").collect()
    assert [r["k"] for r in odd] == [None, None]


@pytest.mark.parametrize("seed", range(4))
def test_medians_of_any_doubles(spark, seed):
    draw = random.Random(seed)
    pool = [draw.choice(EDGES[:12]) if draw.random() < 0.3 else draw.choice([1, -1]) * 10 ** draw.uniform(-300, 300) for _ in range(60)]
    rows = [(draw.randrange(3), draw.choice(pool), draw.choice([None, math.nan, draw.uniform(-1, 1)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    for part, got in ((rows, fill.column_medians(df, ["a", "b"]).first()),
                      *(([r for r in rows if r[0] == g["k"]], g) for g in fill.large_group_medians(df, "k", ["a", "b"]).collect())):
        for i, c in ((1, "a"), (2, "b")):
            known = sorted(r[i] for r in part if r[i] is not None and r[i] == r[i])
            assert got[c] == (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, math.nan), (1, 3.0), (2, math.nan)], "k int, a double")
    assert fill.column_medians(df, ["a"]).first()["a"] == 2.0
    assert sorted(r["a"] for r in fill.fill_column_median(df, ["a"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    for hot_rows in (None, 1_000_000, 1):
        assert sorted(r["a"] for r in fill.fill_group_median(df, "k", ["a"], hot_rows=hot_rows).collect()) == [0.0, 1.0, 2.0, 3.0]
    assert fill.column_medians(df.filter("k = 2"), ["a"]).first()["a"] is None


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


LEFT = [(1, at(9)), (2, at(14)), (3, at(15)), (4, None), (5, at(9, 3)), (6, at(14)), (6, at(14))]


def test_asof_does_not_look_ahead_inside_the_day(spark):
    left = spark.createDataFrame(LEFT, "i int, t timestamp_ntz")
    right = spark.createDataFrame([(at(14), 1, "a"), (at(14), 2, "b"), (at(16), 1, None), (None, 9, "z")], "u timestamp_ntz, n int, v string")
    out = sorted((r["i"], r["v"]) for r in asof.asof_timeline(left, "t", right, "u", ["v"], tie=["n"]).collect())
    assert out == sorted([(1, None), (2, "b"), (3, "b"), (4, None), (5, "b"), (6, "b"), (6, "b")], key=lambda x: (x[0], x[1] or ""))
    assert asof.asof_timeline(left, "t", right.limit(0), "u", ["v"]).filter("v IS NULL").count() == len(LEFT)
    assert asof.asof_timeline(left.limit(0), "t", right, "u", ["v"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_asof_over_many_cells(spark, seed):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    left = [(i, start + dt.timedelta(minutes=draw.choice([7, draw.randrange(900)]))) for i in range(300)]
    right = [(start + dt.timedelta(minutes=draw.randrange(900)), i, draw.choice([None, float(i)])) for i in range(40)]
    got = {r["i"]: r["v"] for r in asof.asof_timeline(
        spark.createDataFrame(left, "i int, t timestamp_ntz").repartition(4), "t",
        spark.createDataFrame(right, "u timestamp_ntz, n int, v double").repartition(3), "u", ["v"], tie=["n"],
    ).collect()}
    for i, t in left:
        before = [(u, n, v) for u, n, v in right if v is not None and u <= t]
        assert got[i] == (max(before)[2] if before else None)


def test_asof_plan_has_no_calendar_and_no_broadcast_hint(spark):
    left = spark.createDataFrame(LEFT, "i int, t timestamp_ntz")
    df = asof.asof_timeline(left, "t", left.withColumnsRenamed({"t": "u", "i": "v"}), "u", ["v"])
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in text and "strategy=broadcast" not in text


def test_ranks_over_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(50), i) for i in range(500)]
    out = ranges.rank_rows(spark.createDataFrame(rows, "g string, x int, i int").repartition(6), ["g"], ["x", "i"]).collect()
    for g in ("a", "b", None):
        mine = sorted((x, i) for h, x, i in rows if h == g)
        assert sorted((r["rank"], r["x"], r["i"]) for r in out if r["g"] == g) == [(n, x, i) for n, (x, i) in enumerate(mine, 1)]
