"""Precision-recall area and average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.functions.sequences import elements
from assayforge.operators.score_steps import mean_precision
from assayforge.schemas import LABEL_MISSING

THRESHOLDS = 200


def label_rows(df: DataFrame, labels: Sequence[str], predictions: Sequence[str],
               missing: int | None = LABEL_MISSING) -> DataFrame:
    """Known labels as rows (label, y, p)."""
    rows = F.array(*[
        F.struct(F.lit(y).alias("label"), F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p"))
        for y, p in zip(labels, predictions)
    ])
    long = df.select(F.inline(rows)).where(F.col("y").isNotNull())
    return long if missing is None else long.where(F.col("y") != missing)


def one_hot_rows(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """(y, p) for every class of every position: y is 1 for the position's own class."""
    rows = elements(df, probabilities, label, position="class", value="p")
    return rows.select(F.when(F.col(label) == F.col("class"), 1).otherwise(0).alias("y"), "p")


def bucket_counts(df: DataFrame, *, y: str = "y", p: str = "p", by: Sequence[str] = (),
                  thresholds: int = THRESHOLDS) -> DataFrame:
    """(by..., b, pos, n): positives and rows of each interval between thresholds; counts of parts add up.

    At most ``thresholds`` rows per group. A prediction that is null, not a number or outside 0..1 raises an
    error: it has no interval.
    """
    last = thresholds - 1
    place = F.greatest(F.ceil(F.col(p) * F.lit(last)) - 1, F.lit(0)).cast("int")
    bucket = F.when(F.col(p).between(0, 1), place).otherwise(
        F.raise_error(F.concat(F.lit("prediction outside 0..1: "), F.coalesce(F.col(p).cast("string"), F.lit("null")))).cast("int"))
    return df.groupBy(*by, bucket.alias("b")).agg(F.sum(F.col(y)).alias("pos"), F.count("*").alias("n"))


def area_of_counts(counts: DataFrame, *, by: Sequence[str] = (), thresholds: int = THRESHOLDS) -> DataFrame:
    """(by..., pr_auc) from ``bucket_counts``: interpolated area under the precision-recall curve."""
    last = thresholds - 1
    grid = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = grid.select(*by, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("b"))
    dense = grid.join(counts, [*by, "b"], "left").fillna(0, ["pos", "n"])
    above = Window.partitionBy(*by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    points = dense.withColumn("tp", F.sum("pos").over(above)).withColumn("all", F.sum("n").over(above))
    order = Window.partitionBy(*by).orderBy("b")
    steps = points.select(
        *by, "b", "tp", "all",
        F.lead("tp").over(order).alias("tp1"),
        F.lead("all").over(order).alias("all1"),
        F.sum("pos").over(Window.partitionBy(*by)).alias("total"),
    ).where(F.col("b") < last)
    dtp = F.col("tp") - F.col("tp1")
    dn = F.col("all") - F.col("all1")
    slope = F.coalesce(F.try_divide(dtp, dn), F.lit(0.0))
    intercept = F.col("tp1") - slope * F.col("all1")
    ratio = F.when((F.col("all") > 0) & (F.col("all1") > 0), F.col("all") / F.col("all1")).otherwise(1.0)
    term = F.coalesce(F.try_divide(slope * (dtp + intercept * F.ln(ratio)), F.col("total")), F.lit(0.0))
    return steps.groupBy(*by).agg(F.sum(term).alias("pr_auc"))


def pr_auc(df: DataFrame, *, y: str = "y", p: str = "p", by: Sequence[str] = (),
           thresholds: int = THRESHOLDS) -> DataFrame:
    """(by..., pr_auc): interpolated area under the precision-recall curve on even thresholds.

    Predictions are counted into one bucket per threshold interval first, so what is shuffled and
    summed afterwards is at most ``thresholds`` rows per group.
    """
    return area_of_counts(bucket_counts(df, y=y, p=p, by=by, thresholds=thresholds), by=by, thresholds=thresholds)


def masked_pr_auc(df: DataFrame, labels: Sequence[str], predictions: Sequence[str], *,
                  missing: int | None = LABEL_MISSING, macro: bool = True) -> DataFrame:
    """One row ``pr_auc``: unweighted mean over the labels, or over all labels flattened."""
    rows = label_rows(df, labels, predictions, missing)
    area = pr_auc(rows, by=["label"] if macro else [])
    return area.agg(F.avg("pr_auc").alias("pr_auc"))


def average_precision(df: DataFrame, *, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, n_positive, average_precision): sum of precision times recall step, ties together.

    Equal scores are counted together before any shuffle; the cumulative counts then run over
    score ranges, so one label with most of the rows is still spread out.
    """
    one = fresh("_all", df)
    result = mean_precision(df if by else df.withColumn(one, F.lit(0)), y=y, p=p, by=[*by] if by else [one])
    return result if by else result.drop(one)
