"""The focal trainer: loss and gradient, fits against NumPy, masking, restart."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge.operators import features, losses, training

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x @ rng.normal(size=(5, 3)) + rng.normal(size=(400, 3)) > 0.8).astype(int)
    y[rng.random((400, 3)) < 0.3] = 2
    y[:7] = 2  # rows without any label
    return x, y


@pytest.fixture(scope="module")
def table(spark, arrays):
    x, y = arrays
    rows = [(i, x[i].tolist(), *(None if v == 2 and i % 2 else int(v) for v in y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, features array<double>, a int, b int, c int").repartition(5).cache()


def loss_of(weights, x, y, macro, gamma=2.0, eps=1e-7):
    """The loss term by term."""
    alphas = []
    for ys in (y.T if macro else [y.ravel()] * 3):
        n = [(ys == 0).sum(), (ys == 1).sum()]
        raw = [1 / math.sqrt(k) if k else 0 for k in n]
        alphas.append([r * sum(n) / sum(a * b for a, b in zip(raw, n)) for r in raw])
    top, bottom, rows = 0.0, 0.0, []
    for xi, yi in zip(x, y):
        one, two = 0.0, 0.0
        for j, t in enumerate(yi):
            if t == 2:
                continue
            p = 1 / (1 + math.exp(-(xi @ weights[j, :-1] + weights[j, -1])))
            p = min(max(p, eps), 1 - eps)
            pt = p if t == 1 else 1 - p
            one -= alphas[j][t] * (1 - pt) ** gamma * math.log(pt)
            two += alphas[j][t]
        if two:
            rows.append(one / two)
        top, bottom = top + one, bottom + two
    return sum(rows) / len(rows) if macro else top / bottom


@pytest.mark.parametrize("macro", [True, False])
def test_loss_and_gradient(table, arrays, macro):
    x, y = arrays
    weights = np.random.default_rng(5).normal(size=(3, 6))
    goal = training.objective(table, LABELS, macro=macro)
    loss, gradient = training.loss_and_gradient(training.training_rows(table, "features", LABELS), goal, weights)
    assert loss == pytest.approx(loss_of(weights, x, y, macro), rel=1e-10)
    step = 1e-6
    for j in range(3):
        for k in range(6):
            up, down = weights.copy(), weights.copy()
            up[j, k] += step
            down[j, k] -= step
            slope = (loss_of(up, x, y, macro) - loss_of(down, x, y, macro)) / (2 * step)
            assert gradient[j, k] == pytest.approx(slope, abs=1e-8)
    model = training.LinearLabels(tuple(LABELS), weights)
    scored = training.score_focal_labels(table, model, keep=["id", *LABELS])
    own = losses.masked_focal_loss(scored, LABELS, [f"{c}_pred" for c in LABELS], macro=macro).first()["loss"]
    assert own == pytest.approx(loss, rel=1e-9)


def numpy_fit(arrays, goal, **options):
    x, y = arrays
    gradient = lambda w: goal.mean(*goal.sums(x, y, w), w)
    return training.minimise(gradient, training.State(0, np.zeros((3, 6))), **options).weights


@pytest.mark.parametrize("options", [{"optimiser": "lbfgs", "steps": 60}, {"optimiser": "adam", "steps": 15}])
def test_fit_equals_numpy(table, arrays, options):
    model = training.train_focal_labels(table, LABELS, penalty=0.01, **options)
    goal = training.objective(table, LABELS, penalty=0.01)
    np.testing.assert_allclose(model.weights, numpy_fit(arrays, goal, **options), atol=1e-6)


def test_lbfgs_reaches_the_minimum(table, arrays):
    goal = training.objective(table, LABELS, penalty=0.01)
    x, y = arrays
    found = numpy_fit(arrays, goal, steps=200)
    gradient = goal.mean(*goal.sums(x, y, found), found)[1]
    assert np.abs(gradient).max() < 1e-7
    slow = numpy_fit(arrays, goal, optimiser="adam", steps=4000)
    np.testing.assert_allclose(found, slow, atol=1e-3)


def test_missing_labels_have_no_effect(table, spark):
    model = training.train_focal_labels(table, LABELS, steps=5)
    more = table.unionByName(spark.createDataFrame([(900 + i, [9.0] * 5, 2, None, 2) for i in range(50)], table.schema))
    again = training.train_focal_labels(more, LABELS, steps=5)
    np.testing.assert_allclose(model.weights, again.weights, atol=1e-10)
    none = training.train_focal_labels(table.withColumns({c: F.lit(2) for c in LABELS}), LABELS, steps=5)
    assert not none.weights.any()
    assert not training.train_focal_labels(table.limit(0), LABELS, steps=2).weights.any()


def test_restart_goes_on(table, tmp_path):
    whole = training.train_focal_labels(table, LABELS, steps=8)
    folder = str(tmp_path / "progress")
    training.train_focal_labels(table, LABELS, steps=3, progress=folder)
    assert training.last_state(table.sparkSession, folder).step == 3
    resumed = training.train_focal_labels(table, LABELS, steps=8, progress=folder)
    np.testing.assert_allclose(whole.weights, resumed.weights, atol=1e-9)
    assert training.last_state(table.sparkSession, folder).step == 8


def test_vectors_and_bad_features(table, spark):
    vectors = features.add_array_vector(table, "features", "vector")
    one = training.train_focal_labels(vectors, ["a"], features="vector", steps=3)
    two = training.train_focal_labels(table, ["a"], steps=3)
    np.testing.assert_allclose(one.weights, two.weights, atol=1e-12)
    bad = spark.createDataFrame([([1.0, None], 1), ([1.0, 2.0], 0)], "features array<double>, a int")
    with pytest.raises(Exception, match="finite numbers"):
        training.train_focal_labels(bad, ["a"], steps=1)
