"""Loss and metrics of a prediction table, chosen by training mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.operators.curves import average_precision, label_rows, masked_pr_auc, one_hot_rows, pr_auc
from assayforge.operators.losses import binary_focal_loss, flatten_pairs, masked_focal_loss, masked_token_loss
from assayforge.schemas import NOT_SELECTED

# Output width and loss per mode.
MODES = {
    "mlm": {"loss": "masked_token_loss", "outputs": "vocabulary size", "validation": False},
    "fps": {"loss": "binary_focal_loss", "outputs": 2048, "validation": True},
    "clf": {"loss": "masked_focal_loss", "outputs": 3, "validation": True},
}


def _metrics(*frames: tuple[str, DataFrame]) -> DataFrame:
    rows = [df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value"))
            for name, df in frames]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def evaluate_labels(df: DataFrame, labels: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """(metric, value) for masked multi-label predictions (mode ``clf``)."""
    rows = label_rows(df, labels, predictions)
    macro_ap = average_precision(rows, by=["label"]).agg(F.avg("average_precision").alias("v"))
    return _metrics(
        ("loss", masked_focal_loss(df, labels, predictions)),
        ("auc", masked_pr_auc(df, labels, predictions)),
        ("average_precision", macro_ap),
        ("n", rows.agg(F.count("*").alias("v"))),
    )


def evaluate_bits(df: DataFrame, bits: str, predictions: str) -> DataFrame:
    """(metric, value) for predicted fingerprints given as two arrays per row (mode ``fps``)."""
    pairs = flatten_pairs(df, bits, predictions)
    return _metrics(
        ("loss", binary_focal_loss(pairs, "label", "prediction")),
        ("auc", pr_auc(pairs, y="label", p="prediction")),
        ("n", pairs.agg(F.count("*").alias("v"))),
    )


def evaluate_tokens(df: DataFrame, *, label: str, original: str, probabilities: str) -> DataFrame:
    """(metric, value) for predicted tokens, a probability array per position (mode ``mlm``)."""
    own = F.get(F.col(probabilities), F.col(original).cast("int"))
    selected = df.where(F.col(label) != NOT_SELECTED)
    p = fresh("_p", df)
    loss = masked_token_loss(df.withColumn(p, own), original=original, label=label, prediction=p)
    return _metrics(
        ("loss", loss),
        ("auc", pr_auc(one_hot_rows(selected, label, probabilities))),
        ("n", selected.agg(F.count("*").alias("v"))),
    )


def evaluate(df: DataFrame, mode: str, **columns) -> DataFrame:
    """Dispatch by mode: ``clf``, ``fps`` or ``mlm``."""
    chosen = {"clf": evaluate_labels, "fps": evaluate_bits, "mlm": evaluate_tokens}
    if mode not in chosen:
        raise ValueError(f"mode: {mode}")
    return chosen[mode](df, **columns)
