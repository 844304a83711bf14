"""Rows that share an id are spread over blocks and shards."""

import numpy as np
from pyspark.sql import functions as F

from quarterdeck.llm import topk


def test_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    draw = np.random.default_rng(7)
    v = draw.integers(-3, 4, (500, 5)).astype(float)
    v[300:] = np.concatenate([v[300:301]] * 200)
    ids = [7] * 300 + list(range(100, 200)) + [8] * 100
    rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(7, v[0].tolist())] * 300
    plain = topk._tile

    def tile(k):
        run = plain(k)

        def bounded(queries, vectors):
            assert max(queries.num_rows, vectors.num_rows) <= 150
            return run(queries, vectors)

        return bounded

    monkeypatch.setattr(topk, "_tile", tile)
    monkeypatch.setattr(topk, "MATRIX_BYTES", 64 * 5 * 8)
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(7, 8, 150)).collect()
    whole = [(i, np.floor(1024 * np.array(x))) for i, x in rows]
    for q in (7, 8, 150):
        scores = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == scores


def test_lists_of_many_shards_meet_in_steps(spark, monkeypatch):
    """With more shards than lists to a step, the tiles' result is projected before it is merged."""
    v = np.random.default_rng(3).integers(-3, 4, (60, 4))
    monkeypatch.setattr(topk, "LEAST_SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = [(i, x.astype(float).tolist()) for i, x in enumerate(v)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    want = [
        (q, rank, j, -score)
        for q in range(0, 60, 20)
        for rank, (score, j) in enumerate(sorted((-int(v[q] @ v[j]) << 20, j) for j in range(60) if j != q)[:3], 1)
    ]
    assert sorted(tuple(r) for r in out) == want


def test_ties_across_parts_of_a_tile(monkeypatch):
    """The bound from maxima of parts leaves out none of the k best, nor their ties, and a query's own rows set none."""
    draw = np.random.default_rng(11)
    monkeypatch.setattr(topk, "PART", 4)
    for large in (1.0, 2.0**40):  # doubles, whole numbers
        q, v = draw.integers(-2, 3, (6, 3)) * large, draw.integers(-2, 3, (150, 3)) * large
        v[60:120] = q[0]
        q_ids, v_ids = np.arange(6), np.concatenate([np.zeros(60, np.int64), draw.permutation(90)])
        for k in (1, 7, 30, 200):
            got = sorted(zip(*map(np.ndarray.tolist, topk.best_in_tile(q_ids, q, v_ids, v, k))))
            want = []
            for i, a in enumerate(q.tolist()):
                scores = [(sum(int(x) * int(y) for x, y in zip(a, b)), j) for j, b in zip(v_ids.tolist(), v.tolist()) if j != i]
                scores = sorted((-min(max(s, -(2**63)), 2**63 - 1), j) for s, j in scores)
                want += [(i, j, -s) for s, j in scores[:k]]
            assert got == sorted(want)
