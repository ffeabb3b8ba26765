import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayforge.functions.udfs import batch_scorer
from assayforge.operators import features, models, quality, scoring, unify, vocabulary
from assayforge.functions.sequences import tokenize
from assayforge.schemas import PROTEINS


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    rows = [(i, [float(v) for v in x[i]], int(x[i, 0] > 0), 2 if i % 3 == 0 else int(x[i, 1] > 0.8), "uvw"[i % 3])
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, a int, b int, kind string")
    return features.add_array_vector(df, "x", "vector").cache()


def test_one_hot_is_alphabetical_and_refuses_unseen(spark, table):
    fitted = features.one_hot_pipeline("kind", "hot").fit(table)
    row = fitted.transform(table.where("kind = 'v'")).first()
    assert list(row["hot"].toArray()) == [0.0, 1.0, 0.0]
    unseen = spark.createDataFrame([("q",)], "kind string")
    with pytest.raises(Py4JJavaError, match="Unseen label: q"):
        fitted.transform(unseen).collect()
    flags = features.one_hot_columns(table, "kind", ["w", "u", "v"], "k_").where("kind = 'u'").first()
    assert (flags["k_u"], flags["k_v"], flags["k_w"]) == (1, 0, 0)
    with pytest.raises(PySparkException, match="unknown category: q"):
        features.one_hot_columns(unseen, "kind", ["u"], "k_").collect()


def test_bits_vector(spark):
    df = spark.createDataFrame([([0, 5, 7],), ([],)], "bits array<int>")
    rows = [list(r["fingerprint"].toArray()) for r in features.add_bits_vector(df, "bits", 8).collect()]
    assert rows == [[1, 0, 0, 0, 0, 1, 0, 1], [0] * 8]


def test_forest_scores_stay_with_their_rows(table):
    data = features.assemble(table, ["vector"])
    forest = models.train_random_forest(data, label="a", trees=20, seed=42)
    scored = models.score(data.repartition(7), forest, keep=["id", "a"], out="p").collect()
    assert len(scored) == 300
    right = sum((r["p"] > 0.5) == bool(r["a"]) for r in scored)
    assert right > 280


def test_masked_labels_train_on_known_rows_only(table):
    data = features.assemble(table, ["vector"])
    fitted = models.train_masked_labels(data, ["a", "b"])
    scored = models.score_masked_labels(data, fitted, keep=["id", "a", "b"]).toPandas()
    assert {"a_pred", "b_pred"} <= set(scored.columns)
    known = scored[scored.b != 2]
    assert ((known.b_pred > 0.5) == (known.b == 1)).mean() > 0.9
    poisoned = data.withColumn("vector_copy", F.lit(1)).withColumn("b", F.when(F.col("b") == 2, 2).otherwise(F.col("b")))
    again = models.train_masked_labels(poisoned.where("b <> 2"), ["b"])
    assert np.allclose(again["b"].coefficients.toArray(), fitted["b"].coefficients.toArray())


@pytest.fixture()
def load_sum():
    def load():
        def predict(ids):
            total = np.asarray(ids).sum(axis=1)
            return np.stack([total / 100.0, total / 200.0, total / 400.0], axis=1)

        return predict

    return load


def test_batch_scorer_keeps_rows_aligned(spark, load_sum):
    df = spark.range(1000).select("id", F.array("id", F.lit(1)).alias("v")).repartition(5)
    score = batch_scorer(load_sum, batch_size=7, input_length=2)
    assert all(r["s"][0] == pytest.approx((r["id"] + 1) / 100) for r in df.select("id", score("v").alias("s")).collect())


def test_submission(assay_test, load_sum):
    wide = unify.pivot_test(assay_test)
    vocab = vocabulary.build_vocabulary(wide.select(tokenize(F.col("smiles")).alias("t")), "t")
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    scored = scoring.score_sequences(wide, "smiles", vocab, load_sum, max_length=8)
    rows = scoring.submission(scoring.spread_scores(scored, "scores", PROTEINS), PROTEINS).collect()
    assert [r["id"] for r in rows] == [100, 101, 102, 103, 104, 105]
    total = ids["C"] + ids["[Dy]"]
    assert [r["binds"] for r in rows[:3]] == [pytest.approx(total / d) for d in (100, 200, 400)]
    assert rows[5]["binds"] == pytest.approx(ids["O"] / 200)
    limited = scoring.submission(scoring.spread_scores(scored, "scores", PROTEINS), PROTEINS, limit=1)
    assert limited.count() <= 3
    report = {r["check"]: r["passed"] for r in quality.submission_report(limited.limit(0)).collect()}
    assert report["rows"] is False
