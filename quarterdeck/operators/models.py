"""Training and scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.operators.metrics import classifier_metrics, roc_auc
from quarterdeck.session import shared_dir


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Everything that is not a key or a label."""
    return [c for c in df.columns if c not in exclude]


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def logistic_baseline(n_train: int, label: str = "label", features: str = "features", weight: str | None = None):
    """Logistic regression with a ridge penalty of strength one on already scaled features.

    Spark averages the loss over the rows, hence the penalty of ``1 / n_train``.
    """
    model = LogisticRegression(
        featuresCol=features,
        labelCol=label,
        maxIter=1000,
        regParam=1.0 / n_train,
        elasticNetParam=0.0,
        standardization=False,
    )
    return model.setWeightCol(weight) if weight else model


def forest(label: str = "label", features: str = "features", weight: str | None = None):
    model = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=100, maxDepth=5, seed=42)
    return model.setWeightCol(weight) if weight else model


def boosted_trees(
    depth: int = 3, label: str = "label", features: str = "features", weight: str | None = None
):
    """Boosting, 100 rounds at rate 0.1; its long lineage is cut every ten rounds."""
    model = GBTClassifier(
        featuresCol=features,
        labelCol=label,
        maxIter=100,
        maxDepth=depth,
        stepSize=0.1,
        seed=42,
        checkpointInterval=10,
    )
    return model.setWeightCol(weight) if weight else model


def fit(estimator, train: DataFrame):
    """Fit, with a checkpoint folder in place for estimators that cut their lineage.

    A model with a summary of its training is written to the shared folder and read back without it: the summary
    holds the session, which cannot be sent to tasks with the model once a query of the session was observed.
    """
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    model = estimator.fit(train)
    if not getattr(model, "hasSummary", False):
        return model
    path = shared_dir(spark)
    model.write().session(spark).save(path)
    return type(model).read().session(spark).load(path)


def score(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted class and the probability of class 1 beside the kept columns."""
    return model.transform(df).select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    )


def ridge_gradient(model, df: DataFrame, features: Sequence[str], label: str = "label", vector: str = "features") -> DataFrame:
    """Slope of the penalised mean loss of a fitted logistic model per feature, as rows ``(feature, slope)``.

    All are about zero where the fit has ended. One aggregate over the rows; the model's numbers are one per feature.
    """
    x = vector_to_array(vector)
    weights, penalty = model.coefficients.toArray().tolist(), model.getRegParam()
    score = F.aggregate(
        F.zip_with(x, F.lit(weights), lambda a, b: a * b), F.lit(float(model.intercept)), lambda total, part: total + part
    )
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - F.col(label)
    rows = df.select(miss.alias("_miss"), x.alias("_x"))
    slopes = [F.avg(F.col("_miss") * F.col("_x")[i]) + F.lit(penalty * w) for i, w in enumerate(weights)]
    cells = [F.struct(F.lit(name).alias("feature"), slope.alias("slope")) for name, slope in zip(features, slopes)]
    whole = F.struct(F.lit("intercept").alias("feature"), F.avg("_miss").alias("slope"))
    return rows.agg(F.array(*cells, whole).alias("_c")).select(F.inline("_c"))


def importance(model, features: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Features by falling importance, names breaking ties."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, values)]
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return ranked if top is None else ranked.limit(top)


def evaluate(scored: DataFrame, name: str, label: str = "label") -> DataFrame:
    """One row of metrics for a scored test set."""
    rates = classifier_metrics(scored, label, "prediction")
    auc = roc_auc(scored, label, "probability").select(F.col("roc_auc")).scalar()
    return rates.select(
        F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", auc.alias("roc_auc")
    )
