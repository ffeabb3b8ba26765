"""Numeric expressions shared by the losses, labels and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    low, high = F.lit(low), F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def inverse_sqrt_weight(count: Column) -> Column:
    """1/sqrt(n), 0 for an empty class."""
    return F.when(count == 0, F.lit(0.0)).otherwise(F.lit(1.0) / F.sqrt(count))


def focal_term(true_probability: Column, gamma: float = 2.0) -> Column:
    """-(1-p)^gamma * ln(p) for the probability given to the true class."""
    return -F.pow(F.lit(1.0) - true_probability, F.lit(gamma)) * F.ln(true_probability)


def true_class_probability(label: Column, prediction: Column) -> Column:
    return F.when(label == 1, prediction).otherwise(F.lit(1.0) - prediction)


def label_mask(label: Column, missing: int) -> Column:
    """1 where the label is known, 0 where it is the missing code or null."""
    return F.when(label.isNull() | (label == missing), F.lit(0)).otherwise(F.lit(1))


def mask_missing(label: Column, missing: int) -> Column:
    """The label with the missing code turned into null."""
    return F.when(label != missing, label)


def one_hot(value: Column, depth: int) -> Column:
    """0/1 array of length ``depth``; all zero when the value is outside it."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.when(i == value, 1).otherwise(0))


def ceil_div(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size)).cast("long")


def uniform_integer(u: Column, low: int, high: int | Column) -> Column:
    """Integer in [low, high) from a uniform draw."""
    high = high if isinstance(high, Column) else F.lit(high)
    return (F.lit(low) + F.floor(u * (high - F.lit(low)))).cast("int")


def categorical(u: Column, probabilities: list[float]) -> Column:
    """Index drawn with the given probabilities from a uniform draw."""
    result, upper = None, 0.0
    for index, probability in enumerate(probabilities[:-1]):
        upper += probability
        condition = u < F.lit(upper)
        result = F.when(condition, index) if result is None else result.when(condition, index)
    last = F.lit(len(probabilities) - 1)
    return last if result is None else result.otherwise(last)
