"""Class weights and weighted, masked focal losses as aggregates over (label, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.functions.numeric import (
    clip,
    focal_term,
    inverse_sqrt_weight,
    label_mask,
    true_class_probability,
)
from assayforge.operators.skew import lookup_join
from assayforge.schemas import FIRST_TOKEN_ID, LABEL_MISSING, NOT_SELECTED
from assayforge.session import pinned

EPSILON = 1e-7
GAMMA = 2.0


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def _alpha(n0: Column, n1: Column) -> tuple[Column, Column]:
    """Weights of both classes, scaled so that the sample weights sum to the sample count."""
    raw0, raw1 = inverse_sqrt_weight(n0), inverse_sqrt_weight(n1)
    scale = F.try_divide((n0 + n1).cast("double"), raw0 * n0 + raw1 * n1)
    return raw0 * F.coalesce(scale, F.lit(0.0)), raw1 * F.coalesce(scale, F.lit(0.0))


def _weight_columns(labels: Sequence[str], pooled: bool) -> list[Column]:
    """Aggregates giving a ``label, n0, n1`` struct per label, or one for all labels together."""
    counts = [(F.count_if(F.col(c) == 0), F.count_if(F.col(c) == 1)) for c in labels]
    if pooled:
        counts = [(_sum([c[0] for c in counts]), _sum([c[1] for c in counts]))] * len(labels)
    return [
        F.struct(F.lit(c).alias("label"), n0.alias("n0"), n1.alias("n1")) for c, (n0, n1) in zip(labels, counts)
    ]


def class_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, n0, n1, alpha0, alpha1): counts of the known labels and their class weights."""
    rows = df.agg(F.array(*_weight_columns(labels, pooled=False)).alias("r")).select(F.inline("r"))
    alpha0, alpha1 = _alpha(F.col("n0"), F.col("n1"))
    return rows.withColumn("alpha0", alpha0).withColumn("alpha1", alpha1)


def row_weights(df: DataFrame, label: str, missing: int = LABEL_MISSING, out: str = "alpha") -> DataFrame:
    """Adds the class weight of every row's label; 0 where the label is missing."""
    weights = class_weights(df, [label]).select(F.struct("alpha0", "alpha1")).scalar()
    w = fresh("_w", df, [out])
    value = F.when(F.col(label) == 0, F.col(w)["alpha0"]).when(F.col(label) == 1, F.col(w)["alpha1"])
    return df.withColumn(w, weights).withColumn(out, F.coalesce(value, F.lit(0.0))).drop(w)


def masked_focal_loss(df: DataFrame, labels: Sequence[str], predictions: Sequence[str], *, macro: bool = True,
                      epsilon: float = EPSILON, gamma: float = GAMMA, missing: int = LABEL_MISSING,
                      batch: str | None = None) -> DataFrame:
    """One row ``loss``: class-weighted binary focal loss over the labels that are known.

    ``macro`` averages each row's weighted loss with weights per label; otherwise one weighted mean
    over everything with weights of the pooled labels. Rows without a known label do not count.
    ``batch`` takes class weights and the loss per batch and averages the batches.
    """
    group = [batch] if batch else []
    terms = [
        focal_term(true_class_probability(F.col(y), clip(F.col(p), epsilon, 1 - epsilon)), gamma)
        for y, p in zip(labels, predictions)
    ]
    if not macro:
        known = [(F.col(y) == c) for y in labels for c in (0, 1)]
        sums = df.groupBy(*group).agg(
            *[F.sum(F.when(k, terms[i // 2])).alias(f"s{i}") for i, k in enumerate(known)],
            *[F.count_if(k).alias(f"n{i}") for i, k in enumerate(known)],
        )
        s = [_sum([F.coalesce(f"s{i}", F.lit(0.0)) for i in range(c, len(known), 2)]) for c in (0, 1)]
        n = [_sum([F.col(f"n{i}") for i in range(c, len(known), 2)]) for c in (0, 1)]
        alpha = _alpha(n[0], n[1])
        loss = F.try_divide(alpha[0] * s[0] + alpha[1] * s[1], alpha[0] * n[0] + alpha[1] * n[1])
        return sums.select(loss.alias("loss")).agg(F.avg("loss").alias("loss"))

    w = fresh("_w", df)
    weights = df.groupBy(*group).agg(F.struct(*[
        column.alias(f"l{i}") for i, column in enumerate(_weight_columns(labels, pooled=False))
    ]).alias(w))
    weighted = lookup_join(df, pinned(weights), group) if batch else df.withColumn(w, weights.scalar())
    numerator, denominator = [], []
    for i, (y, term) in enumerate(zip(labels, terms)):
        alpha0, alpha1 = _alpha(F.col(w)[f"l{i}"]["n0"], F.col(w)[f"l{i}"]["n1"])
        alpha = F.when(F.col(y) == 0, alpha0).otherwise(alpha1)
        mask = label_mask(F.col(y), missing) == 1
        numerator.append(F.when(mask, alpha * term).otherwise(0.0))
        denominator.append(F.when(mask, alpha).otherwise(0.0))
    per_row = weighted.select(*group, F.try_divide(_sum(numerator), _sum(denominator)).alias("loss"))
    per_batch = per_row.groupBy(*group).agg(F.avg("loss").alias("loss"))
    return per_batch.agg(F.avg("loss").alias("loss"))


def token_weights(df: DataFrame, token_id: str) -> DataFrame:
    """(token_id, n, alpha) over all positions; padding and mask ids left out."""
    counts = df.groupBy(F.col(token_id).alias("token_id")).agg(F.count("*").alias("n"))
    return counts.where(F.col("token_id") >= FIRST_TOKEN_ID).withColumn("alpha", inverse_sqrt_weight(F.col("n")))


def masked_token_loss(df: DataFrame, *, original: str, label: str, prediction: str, epsilon: float = EPSILON,
                      gamma: float = GAMMA) -> DataFrame:
    """One row ``loss``: focal loss of the selected positions, weighted by token rarity.

    ``df`` has a row per position; ``prediction`` is the probability given to the original token.
    Frequencies count all positions, selected or not; the weights are not normalised. One pass:
    sums per token, then a weighted total over the tokens.
    """
    selected = F.col(label) != NOT_SELECTED
    term = focal_term(clip(F.col(prediction), epsilon, 1 - epsilon), gamma)
    per_token = df.groupBy(original).agg(
        F.count("*").alias("n"),
        F.count_if(selected).alias("n_selected"),
        F.sum(F.when(selected, term).otherwise(0.0)).alias("s"),
    )
    alpha = F.when(F.col(original) >= FIRST_TOKEN_ID, inverse_sqrt_weight(F.col("n"))).otherwise(0.0)
    return per_token.agg(
        F.try_divide(F.sum(alpha * F.col("s")), F.sum(alpha * F.col("n_selected"))).alias("loss")
    )


def binary_focal_loss(df: DataFrame, label: str, prediction: str, *, epsilon: float = EPSILON,
                      gamma: float = GAMMA) -> DataFrame:
    """One row ``loss``: mean focal loss over 0/1 labels, unweighted."""
    p = clip(F.col(prediction), epsilon, 1 - epsilon)
    return df.agg(F.avg(focal_term(true_class_probability(F.col(label), p), gamma)).alias("loss"))


def flatten_pairs(df: DataFrame, labels: str, predictions: str, *keep: str) -> DataFrame:
    """One row (label, prediction) per element of two equally long arrays."""
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(predictions).alias("prediction"))
    return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.label", "e.prediction")
