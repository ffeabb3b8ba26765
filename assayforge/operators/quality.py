"""Checks of produced datasets as (check, observed, passed) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions.hashing import hash_uint32, key_string

_REPORT = "check string, observed bigint, passed boolean"


def report(df: DataFrame, checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Rows (check, observed, passed) from one pass over ``df``.

    Each check is an aggregate and a SQL condition on ``observed``.
    """
    totals = df.agg(*[value.cast("bigint").alias(f"c{i}") for i, (value, _) in enumerate(checks.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("observed"), F.lit(condition).alias("rule"))
        for i, (name, (_, condition)) in enumerate(checks.items())
    ])
    passed = F.lit(False)
    long = totals.select(F.inline(rows))
    for condition in {c for _, c in checks.values()}:
        passed = F.when(F.col("rule") == condition, F.expr(condition)).otherwise(passed)
    return long.select("check", "observed", passed.alias("passed"))


def unified_report(df: DataFrame, labels: int = 3) -> DataFrame:
    """Checks of the unified dataset: rows present, label arrays and codes within their domain."""
    return report(df, {
        "rows": (F.count("*"), "observed > 0"),
        "missing_smiles": (F.count_if(F.col("smiles").isNull()), "observed = 0"),
        "wrong_label_size": (F.count_if(F.coalesce(F.size("binds") != labels, F.lit(True))), "observed = 0"),
        "wrong_label_value": (
            F.count_if(F.exists("binds", lambda b: b.isNull() | ~b.isin(0, 1, 2))), "observed = 0"),
        "wrong_subset": (
            F.count_if(F.coalesce(~F.col("subset").isin(0, 1, 2), F.lit(True))), "observed = 0"),
    })


def vocabulary_report(vocab: DataFrame) -> DataFrame:
    """Checks of a vocabulary: tokens present, none blank, ids unique and gapless from 2 on."""
    return report(vocab, {
        "tokens": (F.count("*"), "observed > 0"),
        "blank_tokens": (F.count_if(F.length(F.trim("token")) == 0), "observed = 0"),
        "id_gaps": (F.max("token_id") - F.min("token_id") + 1 - F.count_distinct("token_id"), "observed = 0"),
        "first_id": (F.min("token_id"), "observed = 2"),
    })


def submission_report(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Checks of a submission: rows present, ids complete, scores within 0..1."""
    wanted = "observed > 0" if expected_rows is None else f"observed = {expected_rows}"
    return report(df, {
        "rows": (F.count("*"), wanted),
        "missing_ids": (F.count_if(F.col("id").isNull() | (F.col("id") < 0)), "observed = 0"),
        "bad_scores": (F.count_if(F.coalesce(~F.col("binds").between(0, 1), F.lit(True))), "observed = 0"),
    })


def summary(reports: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, checks, passed): whether every check of each stage passed, and ``all`` over them."""
    named = [df.withColumn("stage", F.lit(stage)) for stage, df in reports.items()]
    rows = reduce(DataFrame.unionByName, named)
    both = rows.select(F.explode(F.array("stage", F.lit("all"))).alias("stage"), "passed")
    return both.groupBy("stage").agg(F.count("*").alias("checks"), F.bool_and("passed").alias("passed"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, digest) that do not depend on row order or partitioning; copies count each time.

    The digest is a sum of row hashes, written as text since it may outgrow 64 bits.
    """
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(hash_uint32(key_string(*columns)).cast("decimal(20,0)")).cast("string").alias("digest"),
    )
