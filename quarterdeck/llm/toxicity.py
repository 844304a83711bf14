"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are the positives. The unlabelled texts are drawn from all documents somebody looked
at, toxic or not, without their labels, so that the class prior measured there holds for them. With the class prior p, the risk of a classifier f is estimated as

    p R(f, positives as 1) + max(0, R(f, unlabelled as 0) - p R(f, positives as 0))

and where the last term turns negative, the step goes the other way, so that it does not fit the positives
hidden among the unlabelled (non-negative risk). The prior is the share of toxic rows among labelled ones
that may be learnt from, lowered to ``PRIOR_SHARE`` of it: were it above the share in the sample by chance,
the last term would hold down the scores of clear cases. The classifier is logistic, in numpy, on which
words a text has and on which beginnings of words, once or in several words, so that inflected forms count
together. Of those features, the ``VOCABULARY`` are used whose rate among positives lies furthest above
their prior-corrected rate among clean texts, ``MIN_SIGNAL`` standard deviations at least; the many others
would only be learnt by heart.

The sample is bounded by ``POSITIVES`` and ``UNLABELLED`` documents, those with the smallest hash of their
id. Counts of features are aggregated by Spark; the driver gets the chosen ones and, per sampled document,
the numbers of those it has.

Defined results: a null or empty text, or one without a known word, has the score of no word at all; with
no positive or no unlabelled document to learn from every score is 0. A document labelled twice is toxic
if any label says so. Repeated rows and rows without an id are scored like any other. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import by_slices, held_out, table
from quarterdeck.llm.quality import known_labels, smallest
from quarterdeck.session import materialize

POSITIVES = 3_000
UNLABELLED = 9_000
VOCABULARY = 2_000
MIN_TEXTS = 3
MIN_SIGNAL = 8.0
BEGINNINGS = (4, 5, 6, 7)
SEVERAL = (2, 4)
PRIOR_SHARE = 0.9
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Whole words (ending in ``$``), beginnings of longer words, and those that several distinct words share."""
    words = set(WORD.findall((text or "").lower()))
    out = {w + "$" for w in words}
    for size in BEGINNINGS:
        counts = Counter([w[:size] for w in words if len(w) > size])
        out.update(counts)
        for least in SEVERAL:
            out.update(f"{p}{least}" for p, n in counts.items() if n >= least)
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def scores(self, texts: list[str | None]) -> list[float]:
        known = self.weights.keys()
        margins = np.array([self.bias + sum(map(self.weights.get, sorted(known & features_of(t)))) for t in texts])
        return (1 / (1 + np.exp(-np.clip(margins, -500, 500)))).tolist()


NOTHING = Model(-500.0, {})


def fit(
    doc: np.ndarray, word: np.ndarray, positive: np.ndarray, n_words: int, prior: float,
    steps: int = 600, rate: float = 0.1, decay: float = 1e-5,
) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the whole sample; ``doc`` and ``word`` are the ones of a 0/1 matrix."""
    n = len(positive)
    pos, unl = positive, ~positive
    w, bias = np.zeros(n_words), 0.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(doc, w[word], n) + bias
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        as_clean = np.logaddexp(0, margin)  # the loss for label 0
        hidden = as_clean[unl].mean() - prior * as_clean[pos].mean()
        slope = np.zeros(n)
        if hidden >= 0:
            slope[pos] = (prior * (p[pos] - 1) - prior * p[pos]) / pos.sum()
            slope[unl] = p[unl] / unl.sum()
        else:
            slope[pos] = prior * p[pos] / pos.sum()
            slope[unl] = -p[unl] / unl.sum()
        gradient = np.append(np.bincount(word, slope[doc], n_words) + decay * w, slope.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return float(bias), w


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = by_slices(lambda texts: [sorted(features_of(t)) for t in texts])
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("sample_id"), b.column("label"), pa.array(run(b.column("text")), pa.list_(pa.string()))],
            names=["sample_id", "label", "words"],
        )


def _numbered(numbers: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        code = by_slices(lambda lists: [sorted(numbers[w] for w in known & set(ws)) for ws in lists])
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(code(b.column("words")), pa.list_(pa.int32()))], names=["label", "words"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of positive and unlabelled documents."""
    known = known_labels(labels, "toxic", doc_id)
    toxic = known.filter("label = 1")
    rate = known.agg(F.avg("label")).first()[0]
    if not rate:
        return NOTHING
    texts = docs.select(F.col(f"`{doc_id}`").alias("sample_id"), F.col(f"`{text}`").alias("text"))
    positives = smallest(toxic.select("sample_id", "label"), POSITIVES)
    unlabelled = smallest(known.select("sample_id"), UNLABELLED).withColumn("label", F.lit(0))
    sample = positives.unionByName(unlabelled)
    # At most POSITIVES + UNLABELLED ids of 16 bytes.
    sampled = texts.join(F.broadcast(sample), "sample_id").groupBy("sample_id", "label").agg(F.min("text").alias("text"))
    words = materialize(sampled.mapInArrow(_distinct_words, "sample_id long, label int, words array<string>"))
    n_pos, n_unl = (words.filter(F.col("label") == k).count() for k in (1, 0))
    if not n_pos or not n_unl:
        return NOTHING
    prior = min(0.5, PRIOR_SHARE * float(rate))
    counts = words.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("unl")
    ).filter(F.col("pos") + F.col("unl") >= MIN_TEXTS)
    often, usual = F.col("pos") / n_pos, (F.col("unl") + 1) / (n_unl + 2)
    clean = F.greatest((usual - prior * often) / (1 - prior), F.lit(1 / (n_unl + 2)))
    signal = (often - clean) / F.sqrt(clean * (1 - clean) / n_pos)
    chosen = counts.select("word", signal.alias("signal")).filter(F.col("signal") > MIN_SIGNAL)
    vocabulary = [r["word"] for r in chosen.orderBy(F.desc("signal"), "word").limit(VOCABULARY).collect()]
    numbers = {w: i for i, w in enumerate(vocabulary)}
    got = words.orderBy("sample_id", "label").mapInArrow(_numbered(numbers), "label int, words array<int>").toArrow()
    positive = got.column("label").to_numpy() == 1
    lists = got.column("words").combine_chunks()
    word = lists.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(positive)), np.diff(lists.offsets.to_numpy()))
    bias, weights = fit(doc, word, positive, len(vocabulary), prior)
    return Model(bias, dict(zip(vocabulary, weights.tolist())))


def score(text: Column, model: Model) -> Column:
    """A text's score between 0 and 1."""
    run = by_slices(model.scores)

    @F.arrow_udf("double")
    def toxicity_score(column: pa.Array) -> pa.Array:
        return pa.array(run(column), pa.float64())

    return toxicity_score(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
