"""Files are read back by many tasks."""

from pyspark.sql import functions as F

from quarterdeck.llm import token_files
from quarterdeck.session import materialize


def test_files_are_read_by_a_task_each(spark):
    docs = spark.range(6).selectExpr("id as doc_id", "concat('a text ', id) as text")
    files = token_files.write_tokens(docs.filter("doc_id = 0"))
    for i in range(1, 6):
        files = files.unionByName(token_files.write_tokens(docs.filter(F.col("doc_id") == i)))
    files = materialize(files.coalesce(1))  # as written: one task holds the table
    out = token_files.read_tokens(files).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(6)) and len({r["task"] for r in out}) == 6
