"""Sources, nested payloads, filling, profiles and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import table, units
from quarterdeck.functions import text
from quarterdeck.functions.fixed_values import GLOBAL_KEYWORDS
from quarterdeck.functions.keys import member_flag, quarter_key
from quarterdeck.operators import fill, profile
from quarterdeck.plans.filings import text_features
from quarterdeck.session import shared_dir
from quarterdeck.sources import files, payloads


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    source = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    paths = files.save_tables(source, "customer", base=shared_dir(spark))
    return files.read_csv(spark, paths["customer"], source.schema)


@query(
    "sink_readback",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'csv' AS fmt FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'parquet' FROM supplier""",
)
def sink_readback(spark, d):
    """Two tables written with their manifests, and read back against them."""
    base = shared_dir(spark)
    customers = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    paths = [
        files.save_tables(customers, "customers", base=base)["customers"],
        files.save_tables(suppliers, "suppliers", base=base, fmt="parquet")["suppliers"],
    ]
    csv, parquet = (files.read_saved(spark, p) for p in paths)
    return csv.withColumn("fmt", F.lit("csv")).unionByName(parquet.withColumn("fmt", F.lit("parquet")))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "tagged_files",
    f"""SELECT c_mktsegment AS segment, c_custkey, c_name, c_acctbal FROM customer
    WHERE c_mktsegment IN ({", ".join(f"'{s}'" for s in SEGMENTS)})""",
)
def tagged_files(spark, d):
    """A folder of CSV files per segment, half of them with the columns in another order, as one table."""
    base, rows = shared_dir(spark), table(spark, d, "customer")
    columns = ["c_custkey", "c_name", "c_acctbal"]
    parts = [
        rows.filter(F.col("c_mktsegment") == s).select(*(columns if i % 2 else columns[::-1]))
        for i, s in enumerate(SEGMENTS)
    ]
    paths = files.save_tables(parts, SEGMENTS, "segments", base)
    read = files.raw_csv_tagged(spark, paths, "segment")
    return read.select("segment", F.col("c_custkey").cast(rows.schema["c_custkey"].dataType), "c_name", F.col("c_acctbal").cast("double"))


@query(
    "union_tagged",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source,
       'buyer' AS role FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier', 'seller' FROM supplier""",
)
def union_tagged(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return files.union_tagged(
        {"customer": customers, "supplier": suppliers}, "source", role={"customer": "buyer", "supplier": "seller"}
    )


@query(
    "records_to_table",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.note') AS note FROM events",
)
def records_to_table(spark, d):
    return payloads.records(table(spark, d, "events"), "props", ["event_id"], "k bigint, note string")


@query(
    "json_rows",
    """SELECT o_orderkey, o_orderpriority AS name, o_custkey AS total_pop, (o_orderkey * 2)::BIGINT AS workers,
       100 * (o_custkey::DOUBLE / nullif((o_orderkey * 2)::DOUBLE, 0)) AS rate
       FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT o_orderkey, 'second', 1, 4, 25.0 FROM orders WHERE o_orderstatus = 'F'""",
)
def json_rows(spark, d):
    # F has two data rows, O one, and P only a header or nothing.
    status = F.col("o_orderstatus")
    head = F.lit('[["NAME","POP","WORKERS"]')
    row = F.concat(
        F.lit(',["'), F.col("o_orderpriority"), F.lit('","'), F.col("o_custkey").cast("string"), F.lit('","'),
        (F.col("o_orderkey") * 2).cast("string"), F.lit('"]'),
    )
    body = (
        F.when(status == "F", F.concat(head, row, F.lit(',["second","1","4"]]')))
        .when(status == "O", F.concat(head, row, F.lit("]")))
        .when(F.col("o_totalprice") > 250000, F.concat(head, F.lit("]")))
        .otherwise(F.lit("[]"))
    )
    sent = table(spark, d, "orders").select("o_orderkey", body.alias("body"))
    rows = payloads.json_rows(
        sent, "body", ["o_orderkey"], {"name": "string", "total_pop": "long", "workers": "long"}
    )
    share = F.lit(100.0) * (F.col("total_pop").cast("double") / F.nullif(F.col("workers").cast("double"), F.lit(0.0)))
    return rows.withColumn("rate", share)


@query(
    "json_default",
    """SELECT event_id, coalesce(json_extract(props, '$.k')::DOUBLE, 0) AS k,
       coalesce(json_extract(props, '$.price')::DOUBLE, 1) AS price FROM events""",
)
def json_default(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        payloads.json_default(F.col("props"), "k", 0.0, "double").alias("k"),
        payloads.json_default(F.col("props"), "price", 1.0, "double").alias("price"),
    )


LINK = 'href="([^"]+)"'


@query(
    "explode_children",
    f"""SELECT page_id, (i - 1)::INT AS position, links[i] AS link, coalesce(links[i] IN ('/', '/about', '/contact'), false)
       AS is_site FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS links FROM pages) p,
       unnest(generate_series(1, len(links))) t(i)""",
)
def explode_children(spark, d):
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    rows = payloads.children(table(spark, d, "pages"), links, ["page_id"], "link")
    return rows.withColumn("is_site", member_flag(F.col("link"), ["/", "/about", "/contact"]))


# Filling. The test tables have no nulls, so some values are taken out by rule.

GAPS = """WITH g AS (SELECT o_orderkey, o_custkey, o_orderdate AS day, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 7 <> 0
    THEN o_totalprice END AS v, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey::DOUBLE END AS w FROM orders)"""


def _gaps(spark, d, *keep):
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        *keep,
        F.when((key % 3 != 0) & (owner % 7 != 0), F.col("o_totalprice")).alias("v"),
        F.when(F.col("o_orderpriority") != "5-LOW", key.cast("double")).alias("w"),
    )


V, WW = units("v"), units("w")
V3, W3 = units("v", 3), units("w", 3)


@query(
    "fill_median",
    GAPS + f"""SELECT o_orderkey, o_custkey, coalesce(v, (SELECT median({V}) / 100 FROM g)) AS v,
    coalesce(w, (SELECT median({WW}) / 100 FROM g)) AS w FROM g""",
)
def fill_median(spark, d):
    return fill.fill_column_median(_gaps(spark, d), ["v", "w"], scale=2)


@query(
    "fill_median_train",
    GAPS + f"""SELECT o_orderkey, o_custkey,
    coalesce(v, (SELECT median({V}) / 100 FROM g WHERE day < TIMESTAMP '2000-01-01')) AS v, w FROM g""",
)
def fill_median_train(spark, d):
    # Orders of the earlier years are the training rows.
    rows = _gaps(spark, d, "o_orderdate")
    train = rows.filter("o_orderdate < TIMESTAMP_NTZ '2000-01-01'")
    return fill.fill_column_median(rows, ["v"], fit_on=train, scale=2).drop("o_orderdate")


PICKED = "(list_sort(list({c}))[(count({c}) + 1) // 2] + list_sort(list({c}))[count({c}) // 2 + 1]) / 2"


@query(
    "median_selection",
    f"""WITH l AS (SELECT line_group, l_extendedprice * (1 - l_discount) AS net,
        CASE WHEN l_linenumber % 2 = 0 THEN (l_tax - l_discount) / l_quantity END AS rate
        FROM (SELECT *, l_returnflag || l_linestatus AS line_group FROM lineitem))
    SELECT line_group, {PICKED.format(c="net")} AS net, {PICKED.format(c="rate")} AS rate FROM l GROUP BY 1
    UNION ALL SELECT 'all', {PICKED.format(c="net")}, {PICKED.format(c="rate")} FROM l""",
)
def median_selection(spark, d):
    odd = F.lit(None).cast("double")
    # Every second rate is missing, as null or as NaN.
    rows = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("line_group"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_tax") - F.col("l_discount")) / F.col("l_quantity"))
        .when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(odd).alias("rate"),
    )
    columns = ["net", "rate"]
    whole = fill.column_medians(rows, columns).select(F.lit("all").alias("line_group"), *columns)
    return fill.large_group_medians(rows, "line_group", columns).unionByName(whole)


@query(
    "fill_group_median",
    GAPS + f"""SELECT o_orderkey, o_custkey, coalesce(v, median({V}) OVER (PARTITION BY o_custkey) / 100, 0) AS v,
    coalesce(w, median({WW}) OVER (PARTITION BY o_custkey) / 100, 0) AS w FROM g""",
)
def fill_group_median(spark, d):
    return fill.fill_group_median(_gaps(spark, d), "o_custkey", ["v", "w"], scale=2)


@query(
    "fill_two_stage",
    GAPS + f""", s AS (SELECT o_orderkey, o_custkey,
    coalesce(v, median({V}) OVER (PARTITION BY o_custkey) / 100) AS v,
    coalesce(w, median({WW}) OVER (PARTITION BY o_custkey) / 100) AS w FROM g)
    SELECT o_orderkey, o_custkey, coalesce(v, (SELECT median({V3}) / 1000 FROM s)) AS v,
    coalesce(w, (SELECT median({W3}) / 1000 FROM s)) AS w FROM s""",
)
def fill_two_stage(spark, d):
    return fill.fill_two_stage(_gaps(spark, d), "o_custkey", ["v", "w"], scale=2)


@query(
    "null_profile",
    GAPS + """SELECT * FROM (SELECT 'v' AS "column", count(*) FILTER (WHERE v IS NULL) AS nulls FROM g
    UNION ALL SELECT 'w', count(*) FILTER (WHERE w IS NULL) FROM g
    UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM g) WHERE nulls > 0""",
)
def null_profile(spark, d):
    return profile.null_profile(_gaps(spark, d))


@query(
    "summary",
    f"""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities,
    count(DISTINCT year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR) AS n_quarters,
    min(o_orderdate) AS first_day, max(o_orderdate) AS last_day,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS n_kept,
    sum({units('o_totalprice')})::DOUBLE / (count(*)::DOUBLE * 100) AS mean_price,
    count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS kept_rate FROM orders""",
)
def summary(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey", "o_orderdate", quarter_key(F.col("o_orderdate")).alias("quarter"), "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("kept"),
    )
    return profile.panel_summary(rows, "o_custkey", "quarter", "o_orderdate", "kept", "o_totalprice", 2).toDF(
        "n_rows", "n_entities", "n_quarters", "first_day", "last_day", "n_kept", "kept_rate", "mean_price"
    )


@query("class_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def class_counts(spark, d):
    return profile.class_counts(table(spark, d, "orders"), "o_orderstatus")


@query(
    "class_weights",
    """SELECT quality, count(*) AS n, (SELECT count(*) FROM labels)::DOUBLE
    / ((SELECT count(DISTINCT quality) FROM labels) * count(*))::DOUBLE AS weight FROM labels GROUP BY 1""",
)
def class_weights(spark, d):
    return profile.class_weights(table(spark, d, "labels"), "quality")


def _corr(x: str, y: str) -> str:
    xy, xx, yy = f"sum({x}::HUGEINT * {y})", f"sum({x}::HUGEINT * {x})", f"sum({y}::HUGEINT * {y})"
    return (
        f"(count(*) * {xy} - sum({x}) * sum({y}))::DOUBLE / nullif(sqrt((count(*) * {xx} - sum({x}) * sum({x}))::DOUBLE)"
        f" * sqrt((count(*) * {yy} - sum({y}) * sum({y}))::DOUBLE), 0)"
    )


@query(
    "feature_corr",
    f"""WITH l AS (SELECT l_quantity::BIGINT AS q, {units('l_extendedprice')} AS p, {units('l_discount')} AS d,
    (l_returnflag = 'R')::BIGINT AS y FROM lineitem)
    SELECT 'l_quantity' AS feature, {_corr('q', 'y')} AS corr FROM l
    UNION ALL SELECT 'l_extendedprice', {_corr('p', 'y')} FROM l
    UNION ALL SELECT 'l_discount', {_corr('d', 'y')} FROM l""",
)
def feature_corr(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return profile.label_correlations(
        rows, ["l_quantity", "l_extendedprice", "l_discount"], "y", {"l_extendedprice": 2, "l_discount": 2}
    )


@query(
    "redundant_features",
    f"""WITH l AS (SELECT {units('o_totalprice')} AS p, o_orderkey AS k, o_orderkey * 2 + (o_custkey % 2) AS k2 FROM orders),
    c AS (SELECT 'o_orderkey' AS feature, {_corr('p', 'k')} AS corr FROM l
    UNION ALL SELECT 'twice', {_corr('p', 'k2')} FROM l UNION ALL SELECT 'twice', {_corr('k', 'k2')} FROM l)
    SELECT DISTINCT feature FROM c WHERE abs(corr) > 0.95""",
)
def redundant_features(spark, d):
    rows = table(spark, d, "orders").withColumn("twice", F.col("o_orderkey") * 2 + F.col("o_custkey") % 2)
    return profile.redundant_features(rows, ["o_totalprice", "o_orderkey", "twice"], 0.95, {"o_totalprice": 2})


# Text, always over the whole text.


@query(
    "text_sections",
    """WITH t AS (SELECT conv_id, turn, max(text) FILTER (WHERE role = 'user') AS u,
       max(text) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY ALL)
       SELECT conv_id, turn, 'user' AS role, coalesce(u, '') AS text,
       CASE WHEN u IS NULL AND a IS NULL THEN 'no sections' END AS error FROM t
       UNION ALL SELECT conv_id, turn, 'assistant', coalesce(a, ''),
       CASE WHEN u IS NULL AND a IS NULL THEN 'no sections' END FROM t""",
)
def text_sections(spark, d):
    return payloads.sections(
        table(spark, d, "conversations"), ["conv_id", "turn"], "role", "text", ["user", "assistant"]
    )


NUMBER = "[0-9][0-9,]+"


@query(
    "text_regex_hits",
    f"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(text, '(?i)({NUMBER})', 1),
       regexp_extract_all(source, '(?i)(src[0-9]+)', 1), regexp_extract_all(text, '(?i)(license)', 1)), '|') AS hits,
       len(regexp_extract_all(text, '(?i)({NUMBER})', 1))::BIGINT AS n_numbers FROM documents""",
)
def text_regex_hits(spark, d):
    body = F.col("text")
    hits = F.concat(
        text.section_hits([body], NUMBER),
        text.section_hits([F.col("source")], "src[0-9]+"),
        text.section_hits([body], "license"),
    )
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(hits, "|").alias("hits"), text.regex_count(body, NUMBER).alias("n_numbers")
    )


@query(
    "list_len",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE len(regexp_extract_all(text, '{NUMBER}')) END::BIGINT AS n_hits
       FROM documents""",
)
def list_len(spark, d):
    # Hits written out as list text, as a file would hold them; French rows are malformed.
    hits = F.regexp_extract_all("text", F.lit(f"({NUMBER})"), 1)
    quoted = F.transform(hits, lambda h: F.concat(F.lit("'"), h, F.lit("'")))
    stored = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", F.lit("n/a")).otherwise(stored).alias("mentions")
    )
    return rows.select("doc_id", text.stored_list_len(F.col("mentions")).alias("n_hits"))


def _count(term: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{term}', ''))) // {len(term)})::BIGINT"


@query(
    "text_term_counts",
    f"""SELECT doc_id, {_count('license')} AS n_license, {_count('the')} AS n_the, {_count('on the')} AS n_on_the
       FROM documents""",
)
def text_term_counts(spark, d):
    body = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.term_count(body, "license").alias("n_license"),
        text.term_count(body, "the").alias("n_the"),
        text.term_count(body, "on the").alias("n_on_the"),
    )


@query(
    "filing_features",
    f"""SELECT doc_id AS ticker, n_chars AS filing_date,
       len(regexp_extract_all(text, '{NUMBER}'))::BIGINT + len(regexp_extract_all(source, '{NUMBER}'))::BIGINT AS mw_mentions,
       ({' + '.join(f"contains(lower(text || chr(10) || source), '{w}')::INT" for w in ['the', 'les', 'src1', 'email'])})::BIGINT
       AS global_regions, {_count('license')} AS n_license, {_count('on the')} AS n_on_the FROM documents""",
)
def filing_features(spark, d):
    sections = F.create_map(F.lit("business"), F.col("text"), F.lit("risk_factors"), F.col("source"))
    filed = table(spark, d, "documents").select(
        F.col("doc_id").alias("ticker"), F.col("n_chars").alias("filing_date"), sections.alias("sections")
    )
    terms = {"n_license": "license", "n_on_the": "on the"}
    return text_features(filed, NUMBER, terms, ["the", "les", "src1", "email"])


WORDS = [*GLOBAL_KEYWORDS, "license", "email", "copyright", "the", "les"]
BREADTH = " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)


@query("text_keyword_breadth", f"SELECT doc_id, ({BREADTH})::BIGINT AS breadth FROM documents")
def text_keyword_breadth(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_breadth(F.col("text"), WORDS).alias("breadth"))
