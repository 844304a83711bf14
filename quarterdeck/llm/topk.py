"""Exact top-k search by inner product: tiles of queries and vectors, merged by a tree.

Queries are cut into blocks and vectors into shards, both by a hash of id, vector and number among equal rows; of
equal rows ``k`` at most can be in a list, so no more are placed. A tile is one block against
one shard: a matrix product in a task, of which each query keeps its k best. Every query's lists then meet
in a tree, ``FAN_IN`` lists to a step, so that no task ever holds all lists of a query. Blocks and shards
have bounded rows and, by the longest vector, bounded bytes, and so has the product, which is formed for some queries at a time.

A component x counts as floor(1024 x); scores are sums of whole numbers, so they are exact. Doubles do the
product where no sum can pass 2**53, Python's whole numbers otherwise; a score beyond a long is set to the
nearest long.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component take no part, nor
do rows without an id; a shorter vector counts as filled up with zeros; ties go to the smaller id. A query's
own row is known by its id, so rows that share an id are no partners of each other, and their lists are
merged. With fewer than k partners all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.common import table

K = 10
EVERY = 100
QUERY_ROWS = 16384
SHARD_ROWS = 65536
LEAST_SHARD_ROWS = 1024
#: Of a block's or shard's matrix.
MATRIX_BYTES = 1 << 26
FAN_IN = 16
#: Scores held at a time.
CELLS = 1 << 21
#: Scores of which the largest stands for all when the k best are looked for.
PART = 64
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Whole-number components, a row per vector; filled up with zeros."""
    lists = vectors.combine_chunks()
    flat = np.floor(1024 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _product(queries: np.ndarray, vectors: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Scores, in the memory of ``out`` where doubles hold them exactly, as longs otherwise."""
    width = min(queries.shape[1], vectors.shape[1])
    q, v = queries[:, :width], vectors[:, :width]
    if width * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < 2**53:
        return np.matmul(q, v.T, out=out[: len(q)])
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(v).T
    limit = np.iinfo(np.int64)
    return np.clip(exact, limit.min, limit.max).astype(np.int64)


def _at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row a number that its k-th largest reaches: the k-th largest of maxima of parts, or of all if there are few."""
    parts = scores.shape[1] // PART
    if parts >= k:
        scores = scores[:, : parts * PART].reshape(len(scores), PART, parts).max(axis=1)
    return np.partition(scores, -k, axis=1)[:, -k][:, None]


def best_in_tile(q_ids: np.ndarray, queries: np.ndarray, v_ids: np.ndarray, vectors: np.ndarray, k: int) -> list[np.ndarray]:
    """Query ids, vector ids and scores of each query's k best in a tile."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, vectors = v_ids[order], vectors[order]
    found = []
    step = max(1, CELLS // max(1, len(v_ids)))
    held = np.empty((min(step, len(q_ids)), len(v_ids)))
    for at in range(0, len(q_ids), step):
        ids = q_ids[at : at + step]
        scores = _product(queries[at : at + step], vectors, held)
        own, after = np.searchsorted(v_ids, ids), np.searchsorted(v_ids, ids, "right")
        lowest = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
        for row in np.flatnonzero(own < after):
            scores[row, own[row] : after[row]] = lowest
        if scores.shape[1] > k:
            near = np.flatnonzero(scores >= _at_least(scores, k))
        else:
            near = np.arange(scores.size)
        rows, cols = np.divmod(near, len(v_ids))
        others = ids[rows] != v_ids[cols]
        rows, cols = rows[others], cols[others]
        values = scores[rows, cols].astype(np.int64)
        sort = np.lexsort((cols, ~values, rows))  # ~x falls as x rises
        rows, cols, values = rows[sort], cols[sort], values[sort]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        found.append(np.stack([ids[rows[keep]], v_ids[cols[keep]], values[keep]]))
    return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 3


def _tile(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return FOUND.empty_table()
        found = best_in_tile(
            queries.column("id").to_numpy(), _matrix(queries.column("vector")),
            vectors.column("other_id").to_numpy(), _matrix(vectors.column("other_vector")), k,
        )
        return pa.table([pa.array(c, pa.int64()) for c in found], schema=FOUND)

    return run


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
) -> DataFrame:
    """The ``k`` rows of highest score for every row that ``is_query`` picks: query_id, rank, vec_id, score."""
    rows = vectors.filter(F.col(f"`{vec_id}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"), is_query.alias("asks")
    )
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    most = max(1, MATRIX_BYTES // (8 * (width or 1)))
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // min(SHARD_ROWS, most)), min(tasks, -(-n // LEAST_SHARD_ROWS)))
    blocks = max(1, -(-asking // min(QUERY_ROWS, most)))
    # Of equal rows the first k fill every list; equal rows combine before they are shuffled.
    counted = rows.groupBy("id", "vector", "asks").agg(F.count("*").alias("n"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))))
    hashed = F.xxhash64("id", "vector", "copy")
    queries = rows.filter("asks").select(
        "id", "vector", F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    # Names of their own: of columns that both sides of a cogroup share, Spark drops the second side's if a projection follows.
    candidates = rows.select(
        F.col("id").alias("other_id"), F.col("vector").alias("other_vector"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"),
    )
    lists = (
        queries.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard"))
        .applyInArrow(_tile(k), "query_id long, vec_id long, score long")
    )
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = _merge(
            lists.withColumn("branch", F.pmod(F.xxhash64("vec_id"), F.lit(shards))), ["query_id", "branch"], k
        ).select("query_id", "vec_id", "score")
    return _merge(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
