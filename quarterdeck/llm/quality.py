"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

The statistics come from a text alone: sizes, shares of kinds of characters, words and lines, repetition.
Trees are grown by level on binned values with logistic loss, from a sample of labelled rows that is
bounded by ``SAMPLE_ROWS`` (those with the smallest hash of their id), and kept as flat arrays of
feature, threshold, children and value, which whole batches of rows walk down together.

Defined results: a null text counts as empty and is scored like any other; a label of a row that is held
out, null or not 0 or 1 is not learnt from; a document labelled twice counts as good if any label says so;
with labels of one class only, or none, every score is that class's (1 without any). Repeated rows and
rows without an id are scored like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import by_slices, held_out, table, training_row

SAMPLE_ROWS = 20_000
BINS = 64

# Fixed values.
SPACES = b" \t\n\r\x0b\x0c"
GROUPS = (b"!", b"?", b".", b",", b"|", b"#*$%&", b"<>{}[]\\^~_=+@", b"0123456789", b"\"'()-:;/", b"\n")
FEATURES = (
    "log_words", "word_length", "log_lines", "upper", "lower", "beyond_ascii", *(f"group_{i}" for i in range(len(GROUPS))),
    "distinct_words", "distinct_lines", "capital_words", "sentence_lines", "most_common",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


MASKS = np.array([
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(128, 256))), *map(_mask, GROUPS),
], dtype=np.float64).T


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
        visible = max(1.0, len(data) - seen[list(SPACES)].sum())
        words = (text or "").split()
        n = max(1, len(words))
        lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
        counts = set(words)
        row[:3] = np.log1p(len(words)), visible / n, np.log1p(len(lines))
        row[3 : 3 + MASKS.shape[1]] = seen @ MASKS / visible
        row[-5:] = (
            len(counts) / n,
            len(set(lines)) / max(1, len(lines)),
            sum(map(str.isupper, words)) / n,
            sum(x.rstrip()[-1] in ".!?…" for x in lines) / max(1, len(lines)),
            sum(a == b for a, b in zip(words, words[1:])) / n,
        )
    return out


@dataclass(frozen=True)
class Trees:
    """Flat trees: node i goes left if its feature is at most its threshold; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -500, 500)))


def constant(score: float) -> Trees:
    one, zero = np.zeros(1), np.zeros(1, np.int64)
    margin = 500.0 if score >= 1 else -500.0
    return Trees(margin, zero[:0], zero, one, zero, zero, one, 0)


def fit(
    rows: np.ndarray, labels: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15,
    penalty: float = 1.0, least: float = 1.0,
) -> Trees:
    """Boosted trees with logistic loss; splits are at edges between quantile bins."""
    good = float(labels.mean()) if len(labels) else 1.0
    if good in (0.0, 1.0):
        return constant(good)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], 1)
    n, width = binned.shape
    base = float(np.log(good / (1 - good)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    offsets = np.arange(width) * BINS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - labels, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0, len(nodes), len(nodes), 0])
        at = np.full(n, roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            following = []
            for node in level:
                mine = np.flatnonzero(at == node)
                g, h = slope[mine].sum(), curve[mine].sum()
                nodes[node][4] = -rate * g / (h + penalty)
                if d == depth:
                    continue
                cells = (binned[mine] + offsets).ravel()
                gs = np.bincount(cells, np.repeat(slope[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(curve[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                gain = gs**2 / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g**2 / (h + penalty)
                gain[(hs < least) | (h - hs < least)] = -np.inf
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if not gain[f, b] > 1e-9 or b >= len(edges[f]):
                    continue
                low, high = len(nodes), len(nodes) + 1
                nodes.extend([[0, 0, low, low, 0], [0, 0, high, high, 0]])
                nodes[node][:4] = [f, edges[f][b], low, high]
                at[mine] = np.where(binned[mine, f] <= b, low, high)
                following += [low, high]
            level = following
        values = np.array([x[4] for x in nodes[roots[-1] :]])
        margin += values[at - roots[-1]]
    flat = np.array(nodes)
    is_leaf = flat[:, 2] == np.arange(len(flat))
    whole = [flat[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Trees(base, np.array(roots), whole[0], flat[:, 1], whole[1], whole[2], np.where(is_leaf, flat[:, 4], 0.0), depth)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = by_slices(lambda texts: statistics(texts).tolist())
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(run(batch.column("text")), pa.list_(pa.float64()))], names=["label", "row"]
        )


def known_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """``sample_id`` and ``label`` of the labelled ids that may be learnt from."""
    known = labels.select(F.col(f"`{doc_id}`").alias("sample_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.filter(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1) & training_row(F.col("sample_id")))
    return known.groupBy("sample_id").agg(F.max("label").alias("label"))


def smallest(ids: DataFrame, rows: int) -> DataFrame:
    """A bounded sample: the rows with the smallest hash of their id."""
    return ids.orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on a bounded sample of labelled documents; only their statistics reach the driver."""
    sample = smallest(known_labels(labels, "quality", doc_id), rows)
    # At most ``rows`` ids of 16 bytes.
    texts = docs.select(F.col(f"`{doc_id}`").alias("sample_id"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(F.broadcast(sample), "sample_id").groupBy("sample_id").agg(
        F.first("label").alias("label"), F.min("text").alias("text")
    )
    got = texts.orderBy("sample_id").select("label", "text").mapInArrow(_sample, "label int, row array<double>").toArrow()
    x = np.array(got.column("row").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("label").to_numpy().astype(np.float64))


def score(text: Column, trees: Trees) -> Column:
    """A text's score between 0 and 1."""
    run = by_slices(lambda texts: trees.score(statistics(texts)))

    @F.arrow_udf("double")
    def quality_score(column: pa.Array) -> pa.Array:
        return pa.array(run(column), pa.float64())

    return quality_score(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), trees).alias("score")).select(
        "*", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
