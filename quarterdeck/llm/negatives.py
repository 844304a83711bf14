"""Hard negatives by Kronecker-packed products.

An anchor's positives are the rows of its label that score highest with it; for each, the hard negatives are
the highest scores among rows of other labels that lie between ``LOW`` and ``HIGH`` hundredths of the
positive's score. Scores are inner products of whole numbers floor(256 x).

Several candidates share one wide integer: each component is biased to be non-negative and put into a field
wide enough for the whole sum of products, so that one multiplication per anchor component serves all
candidates of the integer and no field runs into the next. Fields are cut out of the sums, and the biases
subtracted, which gives the exact scores. Where two fields at least fit 53 bits, the wide integers are held in
doubles, which the matrix product adds without rounding; else Python's integers of ``WIDE_FIELDS`` fields.

Anchors are cut into blocks and candidates into shards, by a hash of the row's number and its copy, so that
no label or id decides where a row goes. A tile is a block against a shard, in one task, with bounded rows and bytes; the anchors
are a stated part of the rows. The first pass multiplies only rows of one label with each other, the second
takes all, with the positives found. Each pass keeps a few rows per anchor and tile.

Equal rows (id, label and vector) combine first: one stands for all anchors among them, and as candidates no
more copies are placed than an anchor can return, its own included.

Defined results: rows without an id, label or vector, or with a null or non-finite component, take no part;
an empty vector scores 0 with all, a shorter one counts as filled up with zeros. Rows that share an id but
differ otherwise are different rows: each is an anchor of its own and a candidate for the other. Ties go to
the smaller id. An anchor without a positive, and a positive without a negative in reach, give no rows; so
does an empty table. A score beyond a long is set to the nearest long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.common import table
from quarterdeck.session import materialize

EVERY = 50
MOVED = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
ANCHOR_ROWS = 4096
SHARD_ROWS = 32768
LEAST_SHARD_ROWS = 1024
#: Of a block's or shard's matrix.
MATRIX_BYTES = 1 << 26
#: Scores held at a time.
CELLS = 1 << 20
DOUBLE_BITS = 53
WIDE_FIELDS = 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

POSITIVE = pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([
    ("anchor", pa.int64()), ("slot", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("negative_id", pa.int64()), ("negative_score", pa.int64()),
])


def whole_numbers(vectors: pa.ChunkedArray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) of every component as doubles, a row per vector, filled up with zeros."""
    lists = vectors.combine_chunks()
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class Packed:
    """Candidates' components, several to a wide integer."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray) -> None:
        self.n, self.width = len(candidates), min(candidates.shape[1], anchors.shape[1])
        c, a = candidates[:, : self.width], anchors[:, : self.width]
        self.low, self.anchor_low = min(0.0, c.min(initial=0)), min(0.0, a.min(initial=0))
        largest = (int(c.max(initial=0)) - int(self.low)) * (int(a.max(initial=0)) - int(self.anchor_low))
        self.bits = max(1, (self.width * largest).bit_length())
        self.fields = DOUBLE_BITS // self.bits
        self.narrow = self.fields >= 2
        if not self.narrow:
            self.fields = WIDE_FIELDS
            c, self.low, self.anchor_low = _integers(c), int(self.low), int(self.anchor_low)
        self.sums = c.sum(axis=1)
        biased = c - self.low
        rows = -(-self.n // self.fields)
        filled = np.zeros((rows * self.fields, self.width), biased.dtype)
        filled[: self.n] = biased
        # Row i of the wide integers holds the candidates i, i + rows, i + 2 rows and so on.
        self.wide = filled[:rows].copy()
        for f in range(1, self.fields):
            unit = float(1 << self.bits * f) if self.narrow else 1 << self.bits * f
            self.wide += filled[f * rows : (f + 1) * rows] * unit

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors and candidates, as longs."""
        a = anchors[:, : self.width]
        if not self.narrow:
            a = _integers(a)
        products = (a - self.anchor_low) @ self.wide.T
        products = products.astype(np.int64) if self.narrow else products
        mask = (1 << self.bits) - 1
        fields = [(products >> self.bits * f) & mask for f in range(self.fields)]
        found = np.concatenate(fields, axis=1)[:, : self.n]
        bias = self.low * a.sum(axis=1)[:, None] + self.anchor_low * self.sums[None, :] - self.width * self.low * self.anchor_low
        if self.narrow:
            return found + bias.astype(np.int64)
        return np.clip(found + bias, LEAST, MOST).astype(np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


class _Rows:
    """The rows of a block or shard, by ascending id."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending"), ("copy", "ascending")])
        self.id, self.row, self.label, self.copy = (rows.column(n).to_numpy() for n in ("id", "row", "label", "copy"))
        self.x = whole_numbers(rows.column("vector"))

    def own(self, anchors: _Rows, some: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Which candidates ``mine`` are the anchors ``some`` themselves: the first copy of the same row."""
        return (anchors.row[some][:, None] == self.row[mine][None, :]) & (self.copy[mine] == 1)[None, :]


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` greatest allowed scores; equal ones from the left."""
    rows, cols = [], []
    left, values = allowed.copy(), np.where(allowed, scores, LEAST)
    for _ in range(min(k, scores.shape[1])):
        at = values.argmax(axis=1)
        every = np.arange(len(at))
        # All may be as low as a score can be.
        low = ~left[every, at]
        at[low] = left[low].argmax(axis=1)
        some = left[every, at]
        rows.append(every[some])
        cols.append(at[some])
        left[every, at] = False
        values[every, at] = LEAST
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


def positives_in_tile(anchors: _Rows, shard: _Rows, k: int) -> list[np.ndarray]:
    """Anchor row, id and score of each anchor's best rows of its label."""
    found = []
    order = np.argsort(shard.label, kind="stable")
    labels = shard.label[order]
    for label in np.unique(anchors.label):
        low, high = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
        mine = np.sort(order[low:high])
        if not len(mine):
            continue
        asking = np.flatnonzero(anchors.label == label)
        packed, step = Packed(shard.x[mine], anchors.x[asking]), max(1, CELLS // len(mine))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            scores = packed.scores(anchors.x[some])
            rows, cols = _best(scores, ~shard.own(anchors, some, mine), k)
            found.append(np.stack([anchors.row[some[rows]], shard.id[mine[cols]], scores[rows, cols]]))
    return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 3


def bounds(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score between ``LOW`` and ``HIGH`` hundredths of a positive's, without overflow."""
    whole, rest = np.divmod(positive, 100)
    return LOW * whole - (-LOW * rest // 100), HIGH * whole + HIGH * rest // 100


def negatives_in_tile(
    anchors: _Rows, ids: np.ndarray, scores_of: np.ndarray, known: np.ndarray, shard: _Rows, k: int,
) -> list[np.ndarray]:
    """Anchor row, slot, positive id and score, negative id and score; positives are given a row per anchor."""
    found: list[np.ndarray] = []
    packed, step = Packed(shard.x, anchors.x), max(1, CELLS // max(1, len(shard.id)))
    for at in range(0, len(anchors.id), step):
        some = slice(at, at + step)
        scores = packed.scores(anchors.x[some])
        other = anchors.label[some][:, None] != shard.label[None, :]
        for slot in range(ids.shape[1]):
            asks = known[some, slot]
            low, high = bounds(scores_of[some, slot])
            allowed = other & asks[:, None] & (scores >= low[:, None]) & (scores <= high[:, None])
            rows, cols = _best(scores, allowed, k)
            a = rows + at
            found.append(np.stack([
                anchors.row[a], np.full(len(a), slot), ids[a, slot], scores_of[a, slot], shard.id[cols], scores[rows, cols],
            ]))
    return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 6


def _first(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        if not anchors.num_rows or not shard.num_rows:
            return POSITIVE.empty_table()
        found = positives_in_tile(_Rows(anchors), _Rows(shard), k)
        return pa.table([pa.array(c, t.type) for c, t in zip(found, POSITIVE)], schema=POSITIVE)

    return run


def _second(slots: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        if not anchors.num_rows or not shard.num_rows:
            return NEGATIVE.empty_table()
        # In the order that _Rows gives them.
        anchors = anchors.sort_by([("id", "ascending"), ("row", "ascending"), ("copy", "ascending")])
        lists = anchors.column("positives").to_pylist()
        ids, scores, known = (np.zeros((len(lists), slots), t) for t in (np.int64, np.int64, bool))
        for i, positives in enumerate(lists):
            for p in positives:
                ids[i, p["slot"]], scores[i, p["slot"]], known[i, p["slot"]] = p["positive_id"], p["positive_score"], True
        found = negatives_in_tile(_Rows(anchors), ids, scores, known, _Rows(shard), k)
        return pa.table([pa.array(c, t.type) for c, t in zip(found, NEGATIVE)], schema=NEGATIVE)

    return run


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _tiled(rows: DataFrame, blocks: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Anchors' place and candidates, each copied to the tiles it takes part in."""
    place = F.xxhash64("row", "copy")
    anchors = rows.filter("asks AND copy = 1").withColumns({
        "block": F.pmod(place, F.lit(blocks)).cast("int"),
        "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))),
    })
    candidates = rows.withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
        "shard": F.pmod(place, F.lit(shards)).cast("int"),
    })
    return anchors, candidates


def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """A row per anchor, positive and hard negative: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``label`` is a column's name or an expression.
    """
    named = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), named.cast("long").alias("label"),
        F.col(f"`{vector}`").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    # Equal rows combine before they are shuffled; the number is fixed by the writing.
    counted = rows.groupBy("id", "label", "vector", "asks").agg(F.count("*").alias("n"))
    counted = materialize(counted.withColumn("row", F.monotonically_increasing_id()))
    n, asking, width = counted.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    most = max(1, MATRIX_BYTES // (8 * max(1, width or 0)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // min(SHARD_ROWS, most)), min(tasks, -(-n // LEAST_SHARD_ROWS)))
    blocks = max(1, -(-asking // min(ANCHOR_ROWS, most)))
    copies = F.least("n", F.lit(max(positives + 1, negatives)).cast("long"))
    placed = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    columns = ["id", "row", "label", "copy", "vector", "block", "shard"]

    anchors, candidates = _tiled(placed, blocks, shards)
    tiles = candidates.select(*columns).groupBy("block", "shard")
    found = anchors.select(*columns).groupBy("block", "shard").cogroup(tiles).applyInArrow(
        _first(positives), "anchor long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("slot", F.row_number().over(best) - 1).filter(F.col("slot") < positives)
    # A list of ``positives`` entries at most.
    lists = found.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct("slot", "positive_id", "positive_score")).alias("positives")
    )
    asked = materialize(counted.filter("asks").join(lists, "row").withColumn("copy", F.lit(1).cast("long")))
    anchors, _ = _tiled(asked, blocks, shards)
    found = anchors.select(*columns, "positives").groupBy("block", "shard").cogroup(tiles).applyInArrow(
        _second(positives, negatives),
        "anchor long, slot int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "n")
    return (
        found.join(named, "anchor").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, label=label)


SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
w AS (SELECT r, vec_id, label, list_resize(e, (SELECT max(len(e)) FROM v), 0) AS e FROM v),
s AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
    FROM w a JOIN w c ON a.r <> c.r WHERE a.vec_id % {EVERY} = 0
),
p AS (
    SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS slot
    FROM s WHERE same
),
n AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same
    WHERE p.slot <= {POSITIVES} AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
