"""Metrics whose state is stored and grows with batches of predictions.

The state of a batch is a small table: positives and rows of every threshold interval and label, and the
batch's loss. Each batch has a folder of its own that a repetition replaces, so nothing counts twice, and
states of batches, files or jobs merge by addition. The areas equal those of one table of all rows; the loss
is the mean over batches, with class weights per batch, as a training loop reports it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayforge.operators.curves import THRESHOLDS, area_of_counts, bucket_counts, label_rows
from assayforge.operators.losses import masked_focal_loss
from assayforge.schemas import LABEL_MISSING
from assayforge.streaming.incremental import append_once

EVERY = "all labels"  # stands in the label column of a metric over all labels flattened
STATE = "label string, b int, pos long, n long, thresholds int, loss double"


def curve_state(rows: DataFrame, *, macro: bool = True, thresholds: int = THRESHOLDS) -> DataFrame:
    """State of rows (label, y, p): counts per label, or of all labels flattened. No rows give no state."""
    named = rows.select((F.col("label") if macro else F.lit(EVERY)).alias("label"), "y", "p")
    counts = bucket_counts(named, by=["label"], thresholds=thresholds)
    return counts.select("label", "b", F.col("pos").cast("long").alias("pos"), "n", F.lit(thresholds).alias("thresholds"),
                         F.lit(None).cast("double").alias("loss"))


def batch_state(df: DataFrame, labels: Sequence[str], predictions: Sequence[str], *, macro: bool = True,
                missing: int = LABEL_MISSING, thresholds: int = THRESHOLDS) -> DataFrame:
    """State of one batch of masked multi-label predictions: its counts, and a row with its loss."""
    counts = curve_state(label_rows(df, labels, predictions, missing), macro=macro, thresholds=thresholds)
    loss = masked_focal_loss(df, labels, predictions, macro=macro, missing=missing)
    return counts.unionByName(loss.where("loss IS NOT NULL").select(
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("b"), F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("n"), F.lit(thresholds).alias("thresholds"), "loss"))


def store_state(state: DataFrame, folder: str, batch: int) -> None:
    """Writes the state of batch number ``batch``; the same number again replaces it."""
    state.write.mode("overwrite").parquet(f"{folder}/query_id=manual/batch_id={batch}")


def accumulate_stream(df: DataFrame, folder: str, checkpoint: str, labels: Sequence[str], predictions: Sequence[str],
                      **options) -> StreamingQuery:
    """Adds the state of every micro-batch of arriving predictions to ``folder``."""
    return append_once(df, folder, checkpoint, lambda batch: batch_state(batch, labels, predictions, **options))


def read_state(spark: SparkSession, *folders: str) -> DataFrame:
    """All batches of one or more folders. States counted on different thresholds don't merge and raise."""
    state = spark.read.schema(f"{STATE}, query_id string, batch_id long").option("basePath", folders[0]).parquet(folders[0])
    for folder in folders[1:]:
        state = state.unionByName(spark.read.schema(state.schema).option("basePath", folder).parquet(folder))
    found = [r["thresholds"] for r in state.select("thresholds").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"states on {found[0]} and on {found[1]} thresholds")
    return state


def merged_counts(state: DataFrame) -> DataFrame:
    """(label, b, pos, n, thresholds) summed over the batches; itself a state's counts."""
    return state.where("label IS NOT NULL").groupBy("label", "b", "thresholds").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def areas(state: DataFrame) -> DataFrame:
    """(label, pr_auc) of everything in ``state``."""
    counts = merged_counts(state)
    found = counts.select("thresholds").limit(1).collect()
    thresholds = found[0]["thresholds"] if found else THRESHOLDS
    return area_of_counts(counts.drop("thresholds"), by=["label"], thresholds=thresholds)


def metrics(state: DataFrame) -> DataFrame:
    """(metric, value): loss, the mean over the batches that have one; auc, the mean over the labels; n, known labels."""
    loss = state.agg(F.avg("loss").alias("value")).select(F.lit("loss").alias("metric"), "value")
    auc = areas(state).agg(F.avg("pr_auc").alias("value")).select(F.lit("auc").alias("metric"), "value")
    n = state.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value")).select(F.lit("n").alias("metric"), "value")
    return loss.unionByName(auc).unionByName(n)
