"""Encoding, splitting, scaling, models and metrics on the labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarterdeck.checks.registry import query
from quarterdeck.checks.views import (
    macro,
    mean,
    prices,
    promise_ticker,
    promises,
    queue,
    ratios,
    std,
    table,
)
from quarterdeck.functions.text import regex_count, term_count
from quarterdeck.operators import metrics, split
from quarterdeck.operators.models import assemble, feature_columns
from quarterdeck.plans import training
from quarterdeck.plans.promises import promise_matrix

FEATURES = ["n_chars", "n_lines", "n_numbers", "n_the", "n_license"]


def _documents(spark, d):
    """Text features of every document, joined to its label where it has one."""
    body = F.col("text")
    docs = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        "n_chars",
        term_count(body, "\n").alias("n_lines"),
        regex_count(body, "[0-9][0-9,]+").alias("n_numbers"),
        term_count(body, "the").alias("n_the"),
        term_count(body, "license").alias("n_license"),
    )
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


def _count(term: str, n: int) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), {term}, ''))) // {n})::BIGINT"


DOCS = f"""WITH f AS (SELECT d.doc_id, lang, n_chars, {_count('chr(10)', 1)} AS n_lines,
    len(regexp_extract_all(text, '[0-9][0-9,]+'))::BIGINT AS n_numbers, {_count("'the'", 3)} AS n_the,
    {_count("'license'", 7)} AS n_license, quality, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SPLIT = """, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id))
    <= (count(*) OVER (PARTITION BY quality)) * 20 // 100 THEN 1 ELSE 0 END AS is_test FROM f WHERE quality IS NOT NULL)"""


@query(
    "label_encode",
    """SELECT doc_id, lang, source, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang_encoded,
       (dense_rank() OVER (ORDER BY source) - 1)::INT AS source_encoded FROM documents""",
)
def label_encode(spark, d):
    return split.encode_labels(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"])


@query(
    "ml_features",
    DOCS
    + """ SELECT doc_id, n_chars::DOUBLE + n_lines + n_numbers + n_the + n_license AS total, quality FROM f
    WHERE quality IS NOT NULL""",
)
def ml_features(spark, d):
    rows = _documents(spark, d).filter(F.col("quality").isNotNull())
    names = feature_columns(rows, ["doc_id", "lang", "quality", "toxic"])
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return assemble(rows, names).select("doc_id", total.alias("total"), "quality")


@query("strat_split", DOCS + SPLIT + " SELECT doc_id, quality, is_test FROM s")
def strat_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    return split.stratified_split(rows, "quality", "doc_id").select("doc_id", "quality", "is_test")


@query(
    "strat_split_orders",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
       ORDER BY md5('42:' || o_orderkey)) <= (count(*) OVER (PARTITION BY o_orderstatus)) * 20 // 100
       THEN 1 ELSE 0 END AS is_test FROM orders""",
)
def strat_split_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(rows, "o_orderstatus", "o_orderkey")


_Z = ", ".join(
    f"({c} - (SELECT {mean(c, 0)} FROM s WHERE is_test = 0)) / (SELECT {std(c, 0, 0)} FROM s WHERE is_test = 0) AS {c}_z"
    for c in ["n_chars", "n_the"]
)


@query("zscore", DOCS + SPLIT + f" SELECT doc_id, is_test, {_Z} FROM s")
def zscore(spark, d):
    rows = _documents(spark, d).filter(F.col("quality").isNotNull())
    marked = split.stratified_split(rows, "quality", "doc_id")
    scaled = split.scale_columns(marked, marked.filter("is_test = 0"), {"n_chars": 0, "n_the": 0})
    return scaled.select("doc_id", "is_test", "n_chars_z", "n_the_z")


# A rule stands in for a model: long documents are called good.

RULE = """SELECT quality AS y, (n_chars > 400)::INT AS p, n_chars::DOUBLE AS score
    FROM documents JOIN labels ON documents.doc_id = labels.doc_id"""


def _ruled(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return joined.select(
        F.col("quality").alias("y"),
        (F.col("n_chars") > 400).cast("int").alias("p"),
        F.col("n_chars").cast("double").alias("score"),
    )


@query(
    "clf_metrics",
    f"""WITH r AS ({RULE}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = p)::DOUBLE AS hit,
       count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p = 1) AS called,
       count(*) FILTER (WHERE y = 1) AS actual FROM r),
       m AS (SELECT n, hit / n AS accuracy, tp / called AS precision, tp / actual AS recall FROM c)
       SELECT *, 2.0::DOUBLE * precision * recall / (precision + recall) AS f1 FROM m""",
)
def clf_metrics(spark, d):
    return metrics.classifier_metrics(_ruled(spark, d), "y", "p")


@query(
    "clf_report",
    f"""WITH r AS ({RULE}), c AS (SELECT k, count(*) FILTER (WHERE y = k AND p = k)::DOUBLE AS tp,
       count(*) FILTER (WHERE p = k) AS called, count(*) FILTER (WHERE y = k) AS support
       FROM r, (SELECT unnest([0, 1]) AS k) GROUP BY k),
       m AS (SELECT k::VARCHAR AS class, coalesce(tp / nullif(called, 0), 0) AS precision,
             coalesce(tp / nullif(support, 0), 0) AS recall, support FROM c),
       f AS (SELECT *, coalesce(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
       SELECT class, precision, recall, f1, support FROM f
       UNION ALL SELECT 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1) / 2, sum(support)::BIGINT FROM f
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f""",
)
def clf_report(spark, d):
    return metrics.class_report(_ruled(spark, d), "y", "p")


AUC = """, k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM r),
    u AS (SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg,
          sum(r) FILTER (WHERE y = 1) AS s FROM k)
    SELECT n_pos, n_neg, (2 * s - n_pos * (n_pos + 1))::DOUBLE / nullif(2.0::DOUBLE * n_pos * n_neg, 0) AS roc_auc FROM u"""


@query("roc_auc", f"WITH r AS ({RULE}){AUC}")
def roc_auc(spark, d):
    return metrics.roc_auc(_ruled(spark, d), "y", "score")


@query(
    "roc_auc_orders",
    f"WITH r AS (SELECT (o_orderstatus = 'F')::INT AS y, o_totalprice AS score FROM orders){AUC}",
)
def roc_auc_orders(spark, d):
    rows = table(spark, d, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("score")
    )
    return metrics.roc_auc(rows, "y", "score")


def _prepared(spark, d):
    return training.prepare(_documents(spark, d), {c: 0 for c in FEATURES}, "quality", "doc_id")


@query("ml_logreg")
def ml_logreg(spark, d):
    return training.train_logistic(_prepared(spark, d), "doc_id")


@query("ml_forest")
def ml_forest(spark, d):
    return training.train_forest(_prepared(spark, d), "doc_id")


@query("ml_gbt")
def ml_gbt(spark, d):
    return training.train_boosted(_prepared(spark, d), "doc_id")


@query("importance_topk")
def importance_topk(spark, d):
    return training.forest_importance(_prepared(spark, d), top=10)


@query("ml_promise")
def ml_promise(spark, d):
    matrix = promise_matrix(
        promises(spark, d), prices(spark, d), ratios(spark, d), macro(spark, d), queue(spark, d),
        ticker=promise_ticker(),
    )
    return training.promise_model(matrix, "promise_id")


@query("model_compare")
def model_compare(spark, d):
    return training.compare_models(_prepared(spark, d), "doc_id")


# Certificates: what holds for any right fit, so that SQL can tell it. A row per test document; probabilities are such,
# and the class follows from them.

SCORED = DOCS + SPLIT + " SELECT doc_id, quality AS label, true AS in_range, true AS follows FROM s WHERE is_test = 1"


def _certified(scored):
    p = F.col("probability")
    follows = (p == 0.5) | ((p > 0.5).cast("int") == F.col("prediction"))
    return scored.select("doc_id", "label", p.between(0, 1).alias("in_range"), follows.alias("follows"))


@query("ml_logreg_scores", SCORED)
def ml_logreg_scores(spark, d):
    return _certified(training.train_logistic(_prepared(spark, d), "doc_id"))


@query("ml_forest_scores", SCORED)
def ml_forest_scores(spark, d):
    return _certified(training.train_forest(_prepared(spark, d), "doc_id"))


@query("ml_gbt_scores", SCORED)
def ml_gbt_scores(spark, d):
    return _certified(training.train_boosted(_prepared(spark, d), "doc_id"))


@query(
    "ml_logreg_slopes",
    f"SELECT unnest({[*FEATURES, 'intercept']}) AS feature, true AS flat",
)
def ml_logreg_slopes(spark, d):
    slopes = training.logistic_slopes(_prepared(spark, d))
    return slopes.select("feature", (F.abs("slope") < 1e-4).alias("flat"))


@query(
    "importance_shares",
    f"SELECT unnest({FEATURES}) AS feature, true AS in_range, 1.0::DOUBLE AS total",
)
def importance_shares(spark, d):
    ranked = training.forest_importance(_prepared(spark, d), top=None)
    total = ranked.agg(F.round(F.sum("importance"), 9)).scalar()
    return ranked.select("feature", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"))
