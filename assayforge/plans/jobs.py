"""Whole jobs from input paths to output paths; each returns what it wrote, read back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.functions.sequences import SMILES_PATTERN, replace_linker, tokenize
from assayforge.operators import quality, scoring, unify, views, vocabulary
from assayforge.schemas import PROTEINS, RAW_TEST, RAW_TRAIN, UNIFIED
from assayforge.sources import readers, writers


def prepare_dataset(spark: SparkSession, train: str, test: str, extra: str, out: str, *, seed: int = 42,
                    partitions: int | None = None, order_by: str | None = None,
                    clean: Callable[[Column], Column] = replace_linker) -> DataFrame:
    """Raw train and test Parquet and extra CSV to the unified dataset.

    Of repeated measurements the smallest value counts, or the first by ``order_by``, a whole-number
    column of the train file. Columns that a file lacks are an error.
    """
    readers.require_paths(spark, train, test, extra)
    schema = RAW_TRAIN if order_by is None else T.StructType([*RAW_TRAIN, T.StructField(order_by, T.LongType())])
    raw_train = readers.read_assays(spark, train, schema)
    wide_train = unify.pivot_train(raw_train, order_by=order_by)
    wide_test = unify.pivot_test(readers.read_assays(spark, test, RAW_TEST))
    unified = unify.unify(wide_train, wide_test, readers.read_extra_counts(spark, extra), seed=seed, clean=clean,
                          blocks=raw_train)
    writers.write_unified(unified, out, seed=seed, partitions=partitions)
    return readers.read_parquet(spark, out, schema=UNIFIED)


def extract_vocabulary(spark: SparkSession, unified: str, out: str, *, pattern: str = SMILES_PATTERN,
                       min_frequency: int = 1, max_size: int | None = None) -> DataFrame:
    """Unified dataset to vocabulary; reads only the string column."""
    smiles = readers.read_parquet(spark, unified, schema=UNIFIED, columns=["smiles"])
    tokens = smiles.select(tokenize(F.col("smiles"), pattern).alias("tokens"))
    writers.write_vocabulary(
        vocabulary.build_vocabulary(tokens, "tokens", min_frequency=min_frequency, max_size=max_size), out
    )
    return readers.read_vocabulary(spark, out)


def build_records(spark: SparkSession, unified: str, out: str, *, pattern: str = SMILES_PATTERN) -> DataFrame:
    """Unified dataset to training records, partitioned by subset."""
    df = readers.read_parquet(spark, unified, schema=UNIFIED)
    writers.write_records(views.make_records(df, pattern=pattern), out)
    return readers.read_records(spark, out)


def write_submission(spark: SparkSession, test: str, vocab: str, load: Callable, out: str, *,
                     proteins: Sequence[str] = PROTEINS, max_length: int = 128, batch_size: int = 1024,
                     limit: int | None = None, pattern: str = SMILES_PATTERN, on_overflow: str = "error") -> DataFrame:
    """Raw test Parquet to a scored (id, binds) CSV."""
    readers.require_paths(spark, test, vocab)
    wide = unify.pivot_test(readers.read_assays(spark, test, RAW_TEST), proteins)
    scored = scoring.score_sequences(wide, "smiles", readers.read_vocabulary(spark, vocab), load,
                                     max_length=max_length, batch_size=batch_size, pattern=pattern,
                                     on_overflow=on_overflow)
    rows = scoring.submission(scoring.spread_scores(scored, "scores", proteins), proteins, limit=limit)
    writers.write_csv(rows, out)
    return spark.read.schema("id bigint, binds double").option("header", True).csv(out)


def validate_outputs(spark: SparkSession, *, unified: str, vocab: str, submission: str | None = None) -> DataFrame:
    """(stage, checks, passed) over the produced datasets."""
    stages = {
        "unified": quality.unified_report(readers.read_parquet(spark, unified, schema=UNIFIED)),
        "vocabulary": quality.vocabulary_report(readers.read_vocabulary(spark, vocab)),
    }
    if submission is not None:
        readers.require_paths(spark, submission)
        rows = spark.read.schema("id bigint, binds double").option("header", True).csv(submission)
        stages["submission"] = quality.submission_report(rows)
    return quality.summary(stages)
