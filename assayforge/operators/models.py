"""Training and applying MLlib models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.operators.losses import row_weights
from assayforge.schemas import LABEL_MISSING


def positive_probability(column: str = "probability") -> Column:
    return F.get(vector_to_array(F.col(column)), 1)


def random_forest(*, features: str = "features", label: str = "binds", trees: int = 100, seed: int = 42,
                  max_depth: int = 5) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth)


def train_random_forest(df: DataFrame, **params) -> Model:
    """A forest fitted on ``df``; parameters as in ``random_forest``."""
    return random_forest(**params).fit(df)


def score(df: DataFrame, model: Model, *, keep: Sequence[str], out: str = "binds") -> DataFrame:
    """``keep`` columns and the positive-class probability, computed in the same row."""
    return model.transform(df).select(*keep, positive_probability().alias(out))


def train_masked_labels(df: DataFrame, labels: Sequence[str], *, features: str = "features",
                        missing: int = LABEL_MISSING, estimator: Estimator | None = None) -> dict[str, Model]:
    """One classifier per label, fitted on the rows that know it with rare-class weights."""
    models = {}
    for label in labels:
        known = df.where(F.col(label).isNotNull() & (F.col(label) != missing))
        weighted = row_weights(known, label, missing, out="_weight")
        base = estimator if estimator is not None else LogisticRegression(maxIter=50, regParam=0.01)
        params = {base.getParam("featuresCol"): features, base.getParam("labelCol"): label,
                  base.getParam("weightCol"): "_weight"}
        models[label] = base.copy(params).fit(weighted)
    return models


def score_masked_labels(df: DataFrame, models: Mapping[str, Model], *, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and one ``<label>_pred`` per model."""
    scored, added = df, []
    for label, model in models.items():
        columns = scored.columns
        scored = model.transform(scored).select(*columns, positive_probability().alias(f"{label}_pred"))
        added.append(f"{label}_pred")
    return scored.select(*keep, *added)
