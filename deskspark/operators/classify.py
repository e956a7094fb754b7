"""Trained intent model: TF-IDF and class-balanced multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.operators.features import MAX_TERMS, fit_tfidf
from deskspark.sources.scratch import freeze

MAX_ITERATIONS = 1000


@dataclass(frozen=True)
class IntentModel:
    features: Callable[[DataFrame], DataFrame]
    regression: LogisticRegressionModel
    labels: list[str]


def train_intent(
    df: DataFrame, text: str = "text", label: str = "true_intent",
    max_terms: int = MAX_TERMS, max_iterations: int = MAX_ITERATIONS,
) -> IntentModel:
    """Fit on labelled rows; classes weigh the same whatever their frequency.

    Identical (text, label) rows are folded into one weighted row first, so a
    mass of copies costs one row per training pass.
    """
    rows = df.where(F.col(label).isNotNull())
    folded = freeze(rows.groupBy(text, label).agg(F.count(F.lit(1)).alias("_copies")))
    features = fit_tfidf(folded, text, max_terms, weight="_copies")
    # One row per class.
    sizes = {row[label]: row["n"] for row in folded.groupBy(label).agg(F.sum("_copies").alias("n")).collect()}
    labels, total = sorted(sizes), sum(sizes.values())
    codes = F.create_map(*[F.lit(x) for code, name in enumerate(labels) for x in (name, float(code))])
    weights = F.create_map(*[F.lit(x) for name in labels for x in (name, total / len(labels) / sizes[name])])
    train = (
        features(folded)
        .select(
            "features",
            F.element_at(codes, F.col(label)).alias("_label"),
            (F.col("_copies") * F.element_at(weights, F.col(label))).alias("_weight"),
        )
        .persist()
    )
    regression = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="_weight", family="multinomial",
        maxIter=max_iterations, regParam=1.0 / total, standardization=False,
    ).fit(train)
    train.unpersist()
    return IntentModel(features, regression, labels)


def predict_intent(model: IntentModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``intent`` and ``confidence``, the probability of the best class."""
    scored = model.regression.transform(model.features(df))
    names = F.array(*[F.lit(name) for name in model.labels])
    return scored.withColumns(
        {
            "intent": F.get(names, F.col("prediction").cast("int")),
            "confidence": F.array_max(vector_to_array("probability")),
        }
    ).drop("features", "rawPrediction", "probability", "prediction")
