"""Evaluation of a 0/1 classifier from a table of labels, predictions and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterdeck.functions.exact import ratio
from quarterdeck.operators.ranges import CELL, in_cells, totals_before


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def classifier_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; an undefined value is 0."""
    y, p = F.col(label), F.col(prediction)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("hits"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if(p == 1).alias("called"),
        F.count_if(y == 1).alias("actual"),
    )
    rates = counts.select(
        "n",
        ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        _zero(ratio(F.col("tp"), F.col("called"))).alias("precision"),
        _zero(ratio(F.col("tp"), F.col("actual"))).alias("recall"),
    )
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    # Every row counts once under its label and once under its prediction, so
    # the whole report comes from one grouped pass.
    sides = F.array(
        F.struct(F.col(label).alias("cls"), F.lit(1).alias("actual"), F.lit(0).alias("called")),
        F.struct(F.col(prediction).alias("cls"), F.lit(0).alias("actual"), F.lit(1).alias("called")),
    )
    pairs = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    by_class = (
        pairs.select("n", (F.col(label) == F.col(prediction)).alias("hit"), F.explode(sides).alias("_s"))
        .select("n", "hit", "_s.*")
        .groupBy("cls")
        .agg(
            F.sum(F.col("n") * F.col("actual")).alias("support"),
            F.sum(F.col("n") * F.col("called")).alias("called"),
            F.sum(F.when(F.col("hit"), F.col("n") * F.col("actual")).otherwise(0)).alias("tp"),
        )
    )
    rates = by_class.select(
        F.col("cls").cast("string").alias("class"),
        _zero(ratio(F.col("tp"), F.col("called"))).alias("precision"),
        _zero(ratio(F.col("tp"), F.col("support"))).alias("recall"),
        "support",
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))

    measures = ["precision", "recall", "f1"]
    macro = rates.agg(
        *[(F.sum(m) / F.count(F.lit(1))).alias(m) for m in measures], F.sum("support").alias("support")
    ).select(F.lit("macro avg").alias("class"), *measures, "support")
    weighted = rates.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(m) for m in measures],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("class"), *measures, "support")
    parts = [rates.select("class", *measures, "support"), macro, weighted]
    return reduce(DataFrame.unionByName, parts)


def roc_auc(df: DataFrame, label: str, score: str, cells: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null unless both classes occur.

    Rows are first reduced to counts per distinct score, and those dealt out to ranges of scores, so that the
    running count of lower-scored negatives is a sum over one total per range plus a window inside each. ``cells`` is the number of ranges, by
    default that of the shuffle partitions.
    """
    scored = df.select(F.col(score).cast("double").alias("_score"), F.col(label).alias("_y")).dropna()
    ties = scored.groupBy("_score").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg")
    )
    ranged = in_cells(ties, ["_score"], cells)
    inside = W.partitionBy(CELL).orderBy("_score").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranged.join(totals_before(ranged, F.col("_neg")), CELL).withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    )
    wins = F.col("_pos").cast("decimal(19,0)") * (F.lit(2) * F.col("_below") + F.col("_neg")).cast("decimal(19,0)")
    sums = ranked.agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(wins).alias("_wins")
    )
    pairs = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
        (F.col("_wins").cast("double") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
    )
