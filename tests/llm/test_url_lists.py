"""Listed hosts and pages meet URLs in any spelling."""

from quarterdeck.llm import urls


def test_listed_hosts_in_any_spelling(spark):
    hosts = ["http://cheap-pills.example.com", "https://WWW.cheap-pills.example.com:443/a", "http://me:pw@cheap-pills.example.com./b",
             "http://cheap%2Dpills.example.com:8080?x", "http://cheap-pills.example.com.evil.net2/", "http://not-cheap-pills.example.com/"]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    out = {r["page_id"]: r for r in urls.judge(pages, urls.listed(spark, urls.LISTED, 1)).collect()}
    assert [out[i]["verdict"] for i in range(6)] == ["block"] * 4 + ["allow"] * 2
    assert (out[1]["host"], out[1]["path"], out[0]["path"]) == ("www.cheap-pills.example.com:443", "/a", "")
    # Rules meet host and path as they are.
    plain = urls.judge(pages, urls.listed(spark, [("cheap-pills.example.com", "/", "block")], 0)).collect()
    assert {r["page_id"] for r in plain if r["verdict"] == "block"} == set()


def test_long_list_of_pages(spark):
    rows = spark.range(5000).selectExpr("concat('http://H', id % 700, '.example.org:80/%7Euser/p', id, '%2fx') as url")
    pages = spark.range(0, 10000, 5).selectExpr("id as page_id", "concat('https://u@h', id % 700, '.example.org./~user/p', id, '%2Fx?q') as url")
    out = urls.judge(pages, urls.listed_urls(rows)).collect()
    assert len(out) == 2000 and all((r["verdict"] == "block") == (r["page_id"] < 5000) for r in out)
    stray = spark.createDataFrame([(1, "http://a.b/%zz%4"), (2, "http://a.b/%41%ff%")], "page_id long, url string")
    assert {(r["host"], r["path"]) for r in urls.listed_urls(stray).collect()} == {("a.b", "/%zz%4"), ("a.b", "/A%FF%")}
