"""Odd rows: nulls, empty and very long texts, repeated rows, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarterdeck.llm import licenses, packing, pieces, quality, rules, simhash, token_files, topk, toxicity, urls

PROSE = "The old harbour lies between two hills, and a narrow road leads down to it. "
GOOD = " ".join(a + b for a in "abcdefghij" for b in ("ar", "el", "in", "on", "um", "ant", "est", "ing")) + "."
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, kept string, fp string, doc string"
ROWS = [
    (1, PROSE * 12, "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (5, "one", "en"),
    (6, "x" * 60_000, "en"), (7, PROSE * 900, "en"), (8, "Ünï▁code <|endoftext|> 漢字 🙂 \x1c\x85", "de"),
    (None, PROSE * 12, "en"), (9, "line\n\nline\nline", "en"), (9, "line\n\nline\nline", "en"), (10, "the idiot " + PROSE * 8, "en"), (11, GOOD, "en"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 0, "w", "k", "f", "d") for i, t, g in ROWS], DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (7, 1, 0), (8, 0, 1), (10, 1, 1), (10, None, None), (None, 1, 1), (99, 0, 0)],
        "doc_id long, quality int, toxic int",
    )


def encoded(docs):
    ids = docs.select("doc_id", "text", pieces.encode(F.col("doc_id"), F.col("text")).alias("ids"))
    return ids.select("doc_id", "text", "ids", pieces.decode(F.col("ids")).alias("back"))


def test_pieces(odd, none):
    rows = encoded(odd).collect()
    assert len(rows) == len(ROWS) and all(r["back"] == r["text"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)
    assert [r["ids"] for r in rows if r["text"] == ""] == [[]]
    assert encoded(none).count() == 0


def test_rules(odd, none):
    out = {(r["doc"]["doc_id"], r["n_words"], r["kept"], r["lost_chars"]) for r in rules.judge_lines(odd).collect()}
    assert {(2, 0, False, 0), (3, 0, False, 0), (4, 0, False, 0), (5, 1, False, 0)} <= out
    assert rules.judge_lines(odd).count() == len(ROWS) and rules.judge_lines(none).count() == 0
    # All others are short, empty or repeat themselves.
    assert [r["doc"]["doc_id"] for r in rules.judge_lines(odd).filter("kept").collect()] == [11]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.net/en/x?y", 0), (2, None, 0), (3, "no url", 0), (4, "http://x.net", 0), (5, "http://x.net/", 0),
         (5, "http://x.net/", 0), (None, "ftp://q.org/fr/", 0), (6, "http://anet/", 0), (7, "://net/?#", 0),
         (8, "http://www.cheap-pills.example.com/a", 0), (9, "http://example.com/DE/", 0)],
        "page_id long, url string, host int",
    )
    listed = urls.listed(spark, urls.RULES, 0).unionByName(urls.listed(spark, urls.LISTED, 1))
    out = sorted((tuple(r) for r in urls.judge(pages, listed).collect()), key=str)
    assert out == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "x.net", "", None, "allow"), (5, "x.net", "/", "net/", "block"), (5, "x.net", "/", "net/", "block"),
        (None, "q.org", "/fr/", "org/fr/", "allow"), (6, "anet", "/", None, "allow"), (7, "net", "/", "net/", "block"),
        (8, "www.cheap-pills.example.com", "/a", None, "block"), (9, "example.com", "/DE/", None, "allow"),
    ], key=str)
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers(odd, none, labels, operator):
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (none, labels), (none, labels.limit(0))):
        model = operator.train(docs, known)
        out = docs.select("doc_id", operator.score(F.col("text"), model).alias("score")).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)


def test_simhash(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r["component_id"], []).append(r)
    assert sorted(r["doc_id"] for r in by[2]) == [2, 3, 4] and all(r["fp"] == 0 for r in by[2])
    assert {r["doc_id"] for r in by[1]} >= {1, None}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(by) and None not in {r["doc_id"] for r in kept.collect()}


def test_licenses(spark, odd, none):
    assert {r["license"] for r in licenses.scan(odd).collect()} == {None}
    assert licenses.scan(none).count() == 0
    docs = spark.createDataFrame([
        (1, "Some text of its own.\nreleased under THE mit license\nMore."),
        (2, "This  work is licensed under the\nGNU General Public License, version 3"), (3, "Released under\n\nthe MIT License."),
    ], "i int, text string")
    out = {r["doc"]["i"]: (r["license"], r["n_hits"]) for r in licenses.scan(docs).collect()}
    assert out == {1: ("MIT", 1), 2: ("GPL-3.0", 1), 3: (None, 0)}  # a line, a paragraph, neither
    block = spark.createDataFrame([(1, "A.\n\nThis  work is licensed\nunder the GNU General Public License, version 3\n\nB.")], "i int, text string")
    assert licenses.scan(block).first()["license"] == "GPL-3.0"


def test_packing(odd, none):
    out = packing.pack(odd).collect()
    assert sorted(r["length"] for r in out if r["doc_id"] in (2, 3)) == [1, 1]
    assert sum(r["doc_id"] == 9 for r in out) == 2
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= packing.CAPACITY
    assert packing.pack(none).count() == 0


def test_token_files(odd, none):
    out = token_files.read_tokens(token_files.write_tokens(odd)).collect()
    assert len(out) == len(ROWS)
    out.sort(key=lambda r: r["start"])
    assert out[0]["doc_id"] is None and out[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    assert [r["doc_id"] for r in out[1:]] == sorted(r["doc_id"] for r in out[1:])
    assert token_files.read_tokens(token_files.write_tokens(none)).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [2.0]), (9, [-0.001, 0.0]), (10, [1e300, 1e300])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("asks", F.lit("x"))
    out = topk.top_k(vectors, F.col("vec_id") == 0, k=3)
    limit = 2**63 - 1
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [
        (0, 1, 10, limit), (0, 2, 8, 2 * 1024 * 1024), (0, 3, 1, 1024 * 1024 + 512 * 512)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(vectors, F.col("vec_id") == 0).count() == 5


def test_stages(spark, odd, none, labels, tmp_path):
    for docs, name in ((odd, "odd"), (none, "none")):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.run(spark, folder).count() == (1 if name == "odd" else 0)
