import json

import pytest
from pyspark.sql import functions as F

from quarterdeck.plans import demographics, filings
from quarterdeck.session import materialize, shared_dir
from quarterdeck.sources import files, payloads


def test_csv_round_trip_with_commas_quotes_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, 'Ashburn, VA "west"', 1.5), (2, None, None)], "id long, place string, x double")
    paths = files.save_tables(df, "places", base=shared_dir(spark))
    back = files.read_csv(spark, paths["places"], df.schema)
    assert rows(back) == rows(df)
    assert files.verify_written(df, back) == (2, 3)


def test_save_several_tables(spark):
    base = shared_dir(spark)
    paths = files.save_tables([spark.range(3), spark.range(4)], ["a", "b"], "interim", base, "parquet")
    assert paths["b"].endswith("/interim/b") and spark.read.parquet(paths["b"]).count() == 4


def test_mismatched_names_write_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="2 tables but 1 names"):
        files.save_tables([spark.range(1), spark.range(1)], ["a"], base=str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_verify_written_notices_differences(spark):
    with pytest.raises(ValueError, match="wrote 3 rows, read 2"):
        files.verify_written(spark.range(3), spark.range(2))
    with pytest.raises(ValueError, match="columns differ"):
        files.verify_written(spark.range(3), spark.range(3).toDF("x"))


def test_union_and_pick(spark, rows):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    out = files.union_tagged({"AMT": a, "DLR": b}, "ticker", company_name={"AMT": "American Tower"})
    assert rows(out) == [(1, 2, "AMT", "American Tower"), (3, None, "DLR", None)]
    assert files.pick(a, ["z", "y", "x"]).columns == ["y", "x"]


def test_materialize(spark, rows):
    df = spark.range(10).withColumn("v", F.col("id") / 3)
    assert rows(materialize(df)) == rows(df)


COUNTS = ["100", "50000", "40", "300000", "1200", "5", "60", "30", "2"]


def body(*names):
    return json.dumps([["NAME"] + [f"B{i}" for i in range(9)]] + [[n, *COUNTS] for n in names])


def test_counties(spark):
    df = spark.createDataFrame(
        [("Phoenix, AZ", body("Maricopa County")), ("Alto, TX", body()), ("Austin, TX", "[]"), ("Dallas, TX", None)],
        "location string, body string",
    )
    (row,) = demographics.counties(df).collect()
    assert (row["location"], row["county_name"], row["total_pop"]) == ("Phoenix, AZ", "Maricopa County", 100)
    assert (row["unemployment_rate"], row["pct_bachelors"]) == (8.33, 50.0)
    assert len(row) == 13


def test_states(spark):
    df = spark.createDataFrame([(body("Texas", "Puerto Rico", "Guam"),)], "body string")
    got = {r["state_name"]: r["state_abbr"] for r in demographics.states(df).collect()}
    assert got == {"Texas": "TX", "Puerto Rico": "PR", "Guam": None}


def test_payload_values_convert_strictly(spark):
    df = spark.createDataFrame([('[["N","V"],["a","x1"]]',)], "body string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        payloads.json_rows(df, "body", [], {"n": "string", "v": "long"}).collect()


def test_place_codes(spark, rows):
    df = spark.createDataFrame([("Seattle, WA",), ("Nowhere",)], "location string")
    assert rows(demographics.place_codes(df, "location")) == [("Nowhere", None, None), ("Seattle, WA", "53", "033")]


def test_records_and_defaults(spark, rows):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"c": 5}')], "id int, j string")
    assert rows(payloads.records(df, "j", ["id"], "a int, b string")) == [(1, 1, "x"), (2, None, None)]
    assert rows(df.select("id", payloads.json_default(F.col("j"), "a", 7, "int"))) == [(1, 1), (2, 7)]


def test_sections(spark, rows):
    df = spark.createDataFrame([(1, "business", "text"), (1, "notes", "n"), (2, "notes", "n")], "id int, s string, t string")
    out = payloads.sections(df, ["id"], "s", "t", ["business", "risk"])
    assert rows(out) == [
        (1, "business", "text", None), (1, "risk", "", None),
        (2, "business", "", "no sections"), (2, "risk", "", "no sections"),
    ]


def test_filing_features(spark):
    filing = (
        "DLR", "2024-02-23",
        {"business": "Data centers: 1,200 MW and 30 MW in Europe, Japan. A data center.", "risk_factors": "Renewable power"},
        [("Unit One", "Texas"), ("Unit Two", "Ireland")],
    )
    schema = "ticker string, filing_date string, sections map<string,string>, subsidiaries array<struct<name:string,jurisdiction:string>>"
    df = spark.createDataFrame([filing, ("AMT", "2024-02-27", {}, [])], schema)
    columns = ["mw_mentions", "dc_count_10k", "global_regions", "ai_mentions", "renewable_mentions"]
    got = {r["ticker"]: tuple(r[c] for c in columns) for r in filings.text_features(df).collect()}
    assert got == {"DLR": (2, 2, 2, 0, 1), "AMT": (0, 0, 0, 0, 0)}
    subs = [tuple(r) for r in filings.subsidiaries(df).orderBy("entity_name").collect()]
    assert subs == [("DLR", "Unit One", "Texas", True), ("DLR", "Unit Two", "Ireland", False)]


def test_csv_files_of_other_column_orders(spark, tmp_path):
    for name, text in (("1", "a,b\n1,2\n3,\"x\ny\"\n"), ("2", "b,a\n20,10\n"), ("3", "a,c\n7,8\n"), ("4", "a,b\n5,6\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    expected = [("1", "2"), ("10", "20"), ("3", "x\ny"), ("5", "6"), ("7", None)]
    for path in (str(tmp_path), [str(tmp_path / f"{n}.csv") for n in "4213"]):
        assert sorted((r["a"], r["b"]) for r in files.read_csv(spark, path, "a string, b string").collect()) == expected


def test_large_csv_files_are_split_without_line_feeds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f"{i},{'x' * 90}\n" for i in range(120_000)))
    whole, split = (files.read_csv(spark, str(tmp_path), "a long, b string", multi_line=m) for m in (True, False))
    assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
    assert split.selectExpr("sum(a)", "count(*)").first() == whole.selectExpr("sum(a)", "count(*)").first()


def test_saved_tables_are_checked(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.1), (2, "", 0.1)], "id long, name string, x double")
    base = shared_dir(spark)
    csv, parquet = (files.save_tables(df, f, base=base, fmt=f)[f] for f in ("csv", "parquet"))
    assert rows(files.read_saved(spark, csv)) == rows(files.read_saved(spark, parquet)) == rows(df)
    empty = files.save_tables(df.filter("id > 5"), "empty", base=base)["empty"]
    assert files.read_saved(spark, empty).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.save_tables(df, "csv", base=base)
    files.save_tables(df.limit(1), "csv", base=base, overwrite=True)
    assert files.read_saved(spark, csv).count() == 1


def test_changed_tables_are_noticed(spark):
    base = shared_dir(spark)
    df = spark.range(4).withColumn("x", F.when(F.col("id") > 0, F.col("id")))
    path = files.save_tables(df, "t", base=base, fmt="parquet")["t"]
    spark.range(1).selectExpr("id", "id AS x").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="wrote 4 rows, read 5"):
        files.read_saved(spark, path)
    path = files.save_tables(df, "u", base=base)["u"]
    # A null moved into the other column.
    df.select(F.col("x").alias("id"), F.col("id").alias("x")).write.mode("append").csv(f"{path}/more", header=True)
    other = files.save_tables(df.selectExpr("x AS id", "id AS x"), "v", base=base)["v"]
    manifests = [spark.read.text(f"{p}/{files.MANIFEST}").first()["value"].split("content")[1] for p in (path, other)]
    assert manifests[0] != manifests[1]


def test_a_plan_is_written_in_one_run(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = spark.range(0, 50, 1, 2).mapInArrow(count, "id long")
    files.save_tables(df, "once", base=shared_dir(spark), fmt="parquet")
    assert runs.value == 50


def test_tagged_files_are_one_scan(spark, tmp_path):
    paths = {}
    for i in range(12):
        (tmp_path / f"p {i}").mkdir()
        for part in range(2):
            (tmp_path / f"p {i}" / f"{part}.csv").write_text(f"a,b\n{i},{part}\n")
        paths[f"K{i}"] = str(tmp_path / f"p {i}")
    df = files.raw_csv_tagged(spark, paths, "k")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert sorted((r["k"], r["a"], r["b"]) for r in df.collect()) == sorted((f"K{i}", str(i), str(p)) for i in range(12) for p in range(2))
    with pytest.raises(ValueError, match="named for"):
        files.raw_csv_tagged(spark, {"x": paths["K0"], "y": paths["K0"]}, "k")
