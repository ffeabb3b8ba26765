"""Pivots and metrics that accumulate: any division and order of the input, repeated batches, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from assayforge.operators import curves, metric_state
from assayforge.operators.reshape import pivot_labels
from assayforge.streaming import incremental, stateful

LONG = "id long, part string, place double, value double"


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        place = None if rng.random() < 0.2 else float(i)
        value = None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(rng.randint(-5, 5))
        rows.append((rng.choice([*range(40), None]), rng.choice(["a", "b", "c", "other", None]), place, value))
    return rows


def arrive(spark, folder, rows, schema, name):
    """One file of ``rows`` in ``folder``."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder.parent / name))
    folder.mkdir(exist_ok=True)
    for part in (folder.parent / name).glob("*.parquet"):
        part.rename(folder / f"{name}.parquet")


def forget_last(checkpoint):
    """As if the last batch had failed after writing."""
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()


@pytest.mark.parametrize("seed", [1, 2])
def test_stateful_pivot_equals_the_batch(spark, tmp_path, long_rows, seed):
    rng = random.Random(seed)
    rows = rng.sample(long_rows, len(long_rows))
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    cuts = sorted(rng.sample(range(1, 400), 5))

    def run():
        stream = incremental.stream_parquet(spark, str(folder), spark.createDataFrame([], LONG).schema, files_per_trigger=1)
        stateful.pivot_stream(stream, out, checkpoint, keys=["id"], category="part", value="value", categories=["a", "b", "c"],
                              order_by="place", fill=-9).awaitTermination()

    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 400])):
        arrive(spark, folder, rows[a:b], LONG, f"f{n}")
        if n in (2, 5):  # two runs, the second goes on from the first one's state
            run()
    forget_last(tmp_path / "check")
    run()  # the last batch a second time
    expected = pivot_labels(spark.createDataFrame(long_rows, LONG), keys=["id"], category="part", value="value",
                            categories=["a", "b", "c"], order_by="place", fill=-9)
    got = stateful.read_pivot(spark, out, ["id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_pivot_without_order_and_with_text(spark, tmp_path):
    schema = "k string, part string, value string"
    folder = tmp_path / "in"
    arrive(spark, folder, [("x", "a", "m"), ("x", "a", None), ("y", None, "q"), (None, "a", "q")], schema, "one")
    arrive(spark, folder, [("x", "a", "b"), ("x", "b", "z"), ("z", "a", None)], schema, "two")
    stream = incremental.stream_parquet(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    stateful.pivot_stream(stream, out, str(tmp_path / "check"), keys=["k"], category="part", value="value",
                          categories=["a", "b"]).awaitTermination()
    assert sorted(map(tuple, stateful.read_pivot(spark, out, ["k"]).collect()), key=str) == [
        ("x", "b", "z"), ("y", None, None), ("z", None, None)]


PREDICTED = "id long, a int, b int, pa double, pb double"


@pytest.fixture(scope="module")
def predicted():
    rng = random.Random(8)
    return [(i, rng.choice([0, 1, 2]), rng.choice([0, 0, 2, None]), rng.random(), rng.choice([0.0, 1.0, 0.25])) for i in range(300)]


@pytest.mark.parametrize("macro", [True, False])
def test_any_division_gives_the_same_area(spark, tmp_path, predicted, macro):
    df = spark.createDataFrame(predicted, PREDICTED)
    whole = curves.masked_pr_auc(df, ["a", "b"], ["pa", "pb"], macro=macro).first()["pr_auc"]
    for name, parts in (("one", 1), ("three", 3), ("seven", 7)):
        folder = str(tmp_path / name)
        for batch in [*range(parts), 0, parts - 1]:  # repeated batches change nothing
            rows = df.where(F.col("id") % parts == batch)
            metric_state.store_state(metric_state.batch_state(rows, ["a", "b"], ["pa", "pb"], macro=macro), folder, batch)
        found = {r["metric"]: r["value"] for r in metric_state.metrics(metric_state.read_state(spark, folder)).collect()}
        assert found["auc"] == pytest.approx(whole, abs=1e-12)
        assert found["n"] == sum(r[1] in (0, 1) for r in predicted) + sum(r[2] in (0, 1) for r in predicted)


def test_states_of_two_jobs_merge(spark, tmp_path, predicted):
    df = spark.createDataFrame(predicted, PREDICTED)
    folders = [str(tmp_path / n) for n in ("left", "right")]
    for side, folder in enumerate(folders):
        metric_state.store_state(metric_state.batch_state(df.where(F.col("id") % 2 == side), ["a"], ["pa"]), folder, 0)
    merged = metric_state.areas(metric_state.read_state(spark, *folders)).first()["pr_auc"]
    assert merged == pytest.approx(curves.masked_pr_auc(df, ["a"], ["pa"]).first()["pr_auc"], abs=1e-12)
    metric_state.store_state(metric_state.batch_state(df, ["a"], ["pa"], thresholds=50), folders[0], 1)
    with pytest.raises(ValueError, match="thresholds"):
        metric_state.read_state(spark, *folders)


def test_streamed_state_survives_a_repeated_batch(spark, tmp_path, predicted):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    schema = spark.createDataFrame([], PREDICTED).schema

    def run():
        stream = incremental.stream_parquet(spark, str(folder), schema, files_per_trigger=1)
        metric_state.accumulate_stream(stream, out, str(checkpoint), ["a", "b"], ["pa", "pb"]).awaitTermination()

    arrive(spark, folder, predicted[:100], PREDICTED, "one")
    arrive(spark, folder, predicted[100:], PREDICTED, "two")
    run()
    forget_last(checkpoint)
    run()
    whole = curves.masked_pr_auc(spark.createDataFrame(predicted, PREDICTED), ["a", "b"], ["pa", "pb"]).first()["pr_auc"]
    state = metric_state.read_state(spark, out)
    assert metric_state.areas(state).agg(F.avg("pr_auc")).first()[0] == pytest.approx(whole, abs=1e-12)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], PREDICTED)
    metric_state.store_state(metric_state.batch_state(df, ["a"], ["pa"]), str(tmp_path / "s"), 0)
    state = metric_state.read_state(spark, str(tmp_path / "s"))
    assert {r["metric"]: r["value"] for r in metric_state.metrics(state).collect()} == {"loss": None, "auc": None, "n": 0.0}
