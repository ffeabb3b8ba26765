"""Losses and curves against direct evaluations of their definitions on tiny tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge.operators import curves, evaluate, losses

LABELS, PREDS = ["a", "b", "c"], ["pa", "pb", "pc"]


def arrays(df):
    rows = df.orderBy("k").toPandas()
    return rows[LABELS].to_numpy(), rows[PREDS].to_numpy()


def focal_by_hand(y, p, macro, eps=1e-7, gamma=2.0):
    p = np.clip(p, eps, 1 - eps)
    mask = y != 2
    alpha = np.zeros_like(p)
    for j in range(y.shape[1]):
        pool = y[:, j] if macro else y
        n = [int((pool == c).sum()) for c in (0, 1)]
        w = [1 / math.sqrt(v) if v else 0.0 for v in n]
        scale = sum(n) / sum(a * b for a, b in zip(w, n))
        for c in (0, 1):
            alpha[:, j][y[:, j] == c] = w[c] * scale
    pt = np.where(y == 1, p, 1 - p)
    loss = -alpha * (1 - pt) ** gamma * np.log(pt) * mask
    if macro:
        known = mask.any(axis=1)
        return float(np.mean(loss[known].sum(axis=1) / (alpha * mask)[known].sum(axis=1)))
    return float(loss.sum() / (alpha * mask).sum())


@pytest.mark.parametrize("macro", [True, False])
def test_masked_focal_loss(predictions, macro):
    y, p = arrays(predictions)
    got = losses.masked_focal_loss(predictions, LABELS, PREDS, macro=macro).first()["loss"]
    assert got == pytest.approx(focal_by_hand(y, p, macro), rel=1e-12)


@pytest.mark.parametrize("macro", [True, False])
def test_masked_focal_loss_per_batch(predictions, macro):
    batched = predictions.withColumn("batch", F.floor(F.col("k") / 4))
    y, p = arrays(predictions)
    expected = np.mean([focal_by_hand(y[i:i + 4], p[i:i + 4], macro) for i in (0, 4)])
    got = losses.masked_focal_loss(batched, LABELS, PREDS, macro=macro, batch="batch").first()["loss"]
    assert got == pytest.approx(expected, rel=1e-12)


def test_all_missing_gives_no_loss(spark):
    df = spark.createDataFrame([(2, 0.5)], "y int, p double")
    assert losses.masked_focal_loss(df, ["y"], ["p"]).first()["loss"] is None


def test_class_weights(predictions):
    rows = {r["label"]: r for r in losses.class_weights(predictions, LABELS).collect()}
    assert (rows["a"]["n0"], rows["a"]["n1"]) == (3, 3)
    assert rows["a"]["alpha0"] == pytest.approx(1.0)
    assert (rows["c"]["n0"], rows["c"]["n1"], rows["c"]["alpha1"]) == (6, 0, 0.0)
    for r in rows.values():
        assert r["alpha0"] * r["n0"] + r["alpha1"] * r["n1"] == pytest.approx(r["n0"] + r["n1"])


def test_row_weights_are_zero_for_missing(predictions):
    rows = losses.row_weights(predictions, "b").select("b", "alpha").collect()
    assert all((r["alpha"] == 0.0) == (r["b"] == 2) for r in rows)


def test_masked_token_loss(spark):
    rng = np.random.default_rng(0)
    original = rng.integers(0, 6, 200)
    chosen = rng.random(200) < 0.4
    p = rng.random(200)
    chosen[original == 0] = False
    df = spark.createDataFrame(
        [(int(o), int(o) if c else -1, float(q)) for o, c, q in zip(original, chosen, p)],
        "original int, label int, p double")
    alpha = {t: (1 / math.sqrt((original == t).sum()) if t >= 2 else 0.0) for t in range(6)}
    num = sum(-alpha[o] * (1 - q) ** 2 * math.log(q) for o, c, q in zip(original, chosen, p) if c)
    den = sum(alpha[o] for o, c in zip(original, chosen) if c)
    got = losses.masked_token_loss(df, original="original", label="label", prediction="p").first()["loss"]
    assert got == pytest.approx(num / den, rel=1e-12)


def test_token_weights_leave_out_padding_and_mask(spark):
    df = spark.createDataFrame([(i,) for i in [0, 0, 1, 2, 2, 2, 2, 3]], "t int")
    assert {r["token_id"]: r["alpha"] for r in losses.token_weights(df, "t").collect()} == {2: 0.5, 3: 1.0}


def test_binary_focal_loss(spark):
    df = spark.createDataFrame([([1, 0, 1], [0.9, 0.0, 0.4])], "y array<int>, p array<double>")
    pairs = losses.flatten_pairs(df, "y", "p")
    pt = [0.9, 1 - 1e-7, 0.4]
    expected = np.mean([-((1 - q) ** 2) * math.log(q) for q in pt])
    assert losses.binary_focal_loss(pairs, "label", "prediction").first()["loss"] == pytest.approx(expected, rel=1e-9)


def pr_auc_by_hand(y, p, k=200, eps=1e-7):
    t = np.array([-eps, *[(i + 1) / (k - 1) for i in range(k - 2)], 1 + eps])
    tp = np.array([((p > x) & (y == 1)).sum() for x in t], dtype=float)
    fp = np.array([((p > x) & (y == 0)).sum() for x in t], dtype=float)
    total, area = float((y == 1).sum()), 0.0
    for i in range(k - 1):
        dtp, dn = tp[i] - tp[i + 1], (tp + fp)[i] - (tp + fp)[i + 1]
        slope = dtp / dn if dn else 0.0
        low, high = (tp + fp)[i + 1], (tp + fp)[i]
        ratio = high / low if high > 0 and low > 0 else 1.0
        area += slope * (dtp + (tp[i + 1] - slope * low) * math.log(ratio)) / total if total else 0.0
    return area


def test_pr_auc_equals_thresholds(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(600), 3)
    p[:3], y = [0.0, 1.0, 0.5], (rng.random(600) < 0.3).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    assert curves.pr_auc(df).first()["pr_auc"] == pytest.approx(pr_auc_by_hand(y, p), rel=1e-9)


def test_masked_pr_auc(predictions):
    y, p = arrays(predictions)
    each = [pr_auc_by_hand(y[:, j][y[:, j] != 2], p[:, j][y[:, j] != 2]) for j in range(3)]
    assert curves.masked_pr_auc(predictions, LABELS, PREDS).first()["pr_auc"] == pytest.approx(np.mean(each), rel=1e-9)
    known = y != 2
    micro = curves.masked_pr_auc(predictions, LABELS, PREDS, macro=False).first()["pr_auc"]
    assert micro == pytest.approx(pr_auc_by_hand(y[known], p[known]), rel=1e-9)


def ap_by_hand(y, p):
    area, tp, n, total = 0.0, 0, 0, (y == 1).sum()
    for s in sorted(set(p), reverse=True):
        pos = ((p == s) & (y == 1)).sum()
        tp, n = tp + pos, n + (p == s).sum()
        area += pos / total * tp / n if total else 0.0
    return area


def test_average_precision_with_ties_and_without_positives(predictions):
    y, p = arrays(predictions)
    rows = curves.average_precision(curves.label_rows(predictions, LABELS, PREDS), by=["label"]).collect()
    got = {r["label"]: r for r in rows}
    for j, label in enumerate(LABELS):
        known = y[:, j] != 2
        assert got[label]["average_precision"] == pytest.approx(ap_by_hand(y[known, j], p[known, j]))
        assert got[label]["n"] == known.sum()
    assert got["c"]["average_precision"] == 0.0


def test_average_precision_of_one_large_group(spark):
    rng = np.random.default_rng(1)
    y, p = (rng.random(3000) < 0.2).astype(int), np.round(rng.random(3000), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(6)
    assert curves.average_precision(df).first()["average_precision"] == pytest.approx(ap_by_hand(y, p))


def test_evaluate_modes(spark, predictions):
    clf = {r["metric"]: r["value"] for r in evaluate.evaluate(predictions, "clf", labels=LABELS, predictions=PREDS).collect()}
    y, p = arrays(predictions)
    assert clf["loss"] == pytest.approx(focal_by_hand(y, p, True)) and clf["n"] == (y != 2).sum()
    tokens = spark.createDataFrame(
        [(2, 2, [0.1, 0.1, 0.5, 0.3]), (3, -1, [0.2, 0.2, 0.3, 0.3]), (3, 3, [0.0, 0.1, 0.2, 0.7])],
        "original int, label int, probs array<double>")
    mlm = {r["metric"]: r["value"] for r in evaluate.evaluate(
        tokens, "mlm", label="label", original="original", probabilities="probs").collect()}
    hot = np.array([0, 0, 1, 0, 0, 0, 0, 1])
    flat = np.array([0.1, 0.1, 0.5, 0.3, 0.0, 0.1, 0.2, 0.7])
    assert mlm["auc"] == pytest.approx(pr_auc_by_hand(hot, flat)) and mlm["n"] == 2
    bits = spark.createDataFrame([([1, 0], [0.8, 0.3])], "b array<int>, p array<double>")
    fps = {r["metric"]: r["value"] for r in evaluate.evaluate(bits, "fps", bits="b", predictions="p").collect()}
    assert fps["n"] == 2 and fps["auc"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        evaluate.evaluate(bits, "other")


@pytest.mark.parametrize("p", [1.02, -0.1, float("nan"), None])
def test_pr_auc_refuses_predictions_outside_its_range(spark, p):
    df = spark.createDataFrame([(1, 0.5), (0, 0.2), (1, p)], "y int, p double")
    with pytest.raises(Exception, match="outside 0..1"):
        curves.pr_auc(df).collect()
