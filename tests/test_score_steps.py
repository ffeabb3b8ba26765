"""Average precision from packed runs, against a plain sum over sorted scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayforge.operators import curves, score_steps

SCHEMA = "g string, k int, y int, p double"


@pytest.fixture
def small(monkeypatch):
    for name, value in (("RUN_ROWS", 60), ("RANGE_ROWS", 50), ("SAMPLE_EVERY", 8)):
        monkeypatch.setattr(score_steps, name, value)


def brute(rows):
    """(n, n_positive, average_precision) of (y, p) rows: not-a-number first, null last, ties together."""
    def place(p):
        return (2, 0.0) if p is None else (0, 0.0) if math.isnan(p) else (1, -(p + 0.0))
    ties = {}
    for y, p in rows:
        ties.setdefault(place(p), []).append(y)
    pos = n = 0
    area = 0.0
    for _, ys in sorted(ties.items()):
        own = sum(y or 0 for y in ys)
        pos, n = pos + own, n + len(ys)
        area += own * pos / n
    known = any(y is not None for y, _ in rows)
    return n, pos if known else None, area / pos if pos else 0.0


def test_groups_ties_and_odd_scores_over_many_ranges(spark, small):
    rng = random.Random(4)
    odd = [math.nan, math.inf, -math.inf, None, 0.0, -0.0, -1e-300, 5e-324]
    rows = []
    for i in range(3000):
        p = rng.choice(odd) if i % 9 == 0 else round(rng.random(), 2) if i % 2 else rng.gauss(0, 1)
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), rng.choice([1, 1, 2]), rng.choice([0, 1, 1, None]), p))
    rows += [("d", 1, None, 0.5), ("d", 1, None, 0.25), (None, 1, 1, 0.5)]
    got = curves.average_precision(spark.createDataFrame(rows, SCHEMA).repartition(3), by=["g", "k"]).collect()
    want = {}
    for g, k, y, p in rows:
        if g is not None:
            want.setdefault((g, k), []).append((y, p))
    assert {(r["g"], r["k"]) for r in got} == set(want)
    for r in got:
        n, pos, ap = brute(want[r["g"], r["k"]])
        assert (r["n"], r["n_positive"]) == (n, pos) and r["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_a_score_of_most_rows_is_one_entry_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(score_steps, "RUN_ROWS", 1000)
    rows = spark.range(0, 20000, 1, 2).select(
        F.lit(0).alias("g"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 10 < 9, 0.5).otherwise(F.col("id") / 20000).alias("p"))
    runs = score_steps._runs(rows, ["g"], "y", "p", "size", "steps")
    sizes = [r["size"] for r in runs.select("size").collect()]
    assert len(sizes) >= 2 and sum(sizes) < 2000 + 2 * len(sizes)
    got = curves.average_precision(rows).collect()
    n, pos, ap = brute([(r["y"], r["p"]) for r in rows.collect()])
    assert len(got) == 1 and tuple(got[0])[:2] == (n, pos) and got[0]["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_no_rows_and_columns_of_the_same_names(spark, small):
    empty = spark.createDataFrame([], SCHEMA)
    assert curves.average_precision(empty).collect() == [] == curves.average_precision(empty, by=["g"]).collect()
    named = spark.createDataFrame([("x", i % 2, i / 100) for i in range(100)], "_area string, y int, p double")
    got = curves.average_precision(named, by=["_area"]).first()
    assert got["average_precision"] == pytest.approx(brute([(i % 2, i / 100) for i in range(100)])[2], abs=1e-12)


def test_what_a_task_sorts_at_once_is_bounded_and_packed_small(spark):
    rows = spark.range(0, 900_000, 1, 1).select(
        F.lit(0).alias("g"), (F.col("id") % 2).alias("y"), (F.pmod(F.xxhash64("id"), F.lit(2**32)) / 2**32).alias("p"))
    runs = score_steps._runs(rows, ["g"], "y", "p", "size", "steps").select("size", F.octet_length("steps").alias("bytes")).collect()
    assert sum(r["size"] for r in runs) > 899_000 and max(r["size"] for r in runs) <= 300_000
    assert all(r["bytes"] < 7 * r["size"] for r in runs)


def test_runs_of_a_task_are_cut_together(spark, small, monkeypatch):
    monkeypatch.setattr(score_steps, "RUNS_CUT", 3)
    held = [("ab"[i % 3 == 0], i % 2, i * 7919 % 109 / 109) for i in range(1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = curves.average_precision(spark.createDataFrame(held, "g string, y int, p double").coalesce(1), by=["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["g"] for r in got) == ["a", "b"]
    for r in got:
        n, pos, ap = brute([(y, p) for g, y, p in held if g == r["g"]])
        assert (r["n"], r["n_positive"]) == (n, pos) and r["average_precision"] == pytest.approx(ap, abs=1e-12)
