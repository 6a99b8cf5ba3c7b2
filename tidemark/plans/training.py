"""Conversion model on assembled features, and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFIERS = {
    "logistic": LogisticRegression,
    "fm": FMClassifier,
    "gbt": GBTClassifier,
}


def _as_vector(df: DataFrame, features: str) -> Column:
    """The feature column as an ML vector; sparse vectors stay as they are."""
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    return F.col(features) if is_vector else array_to_vector(features)


def fit_classifier(
    train: DataFrame, features: str, label: str, kind: str = "logistic", **options
) -> PipelineModel:
    """Binary model on a column of features, an array or an ML vector."""
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier: {kind}")
    model = CLASSIFIERS[kind](featuresCol="_features", labelCol="_label", **options)
    rows = train.select(
        _as_vector(train, features).alias("_features"),
        F.col(label).cast("double").alias("_label"),
    )
    return Pipeline(stages=[model]).fit(rows)


def score(df: DataFrame, model: PipelineModel, features: str) -> DataFrame:
    """Add ``prob`` and ``logit`` to every row; a map over the rows, nothing is reordered."""
    scored = model.transform(df.withColumn("_features", _as_vector(df, features)))
    prob = vector_to_array("probability")[1]
    # A probability may round to exactly 0 or 1, which has no finite logit.
    inner = F.least(F.greatest(F.col("prob"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    return scored.select(*df.columns, prob.alias("prob")).withColumn(
        "logit", F.ln(inner) - F.log1p(-inner)
    )
