"""Hard negatives against brute force: ties, copies, few rows, hot cells, lengths, nulls, clashing columns."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge.llm import multi_index

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, k=5, scale=256):
    clean = [(i, vec_id, label, np.floor(np.array(v, float) * scale).astype(int)) for i, (vec_id, v, label) in enumerate(rows)
             if vec_id is not None and label is not None and v is not None
             and all(x is not None and np.isfinite(x) for x in v)]
    out, answered = [], set()
    for i, vec_id, label, q in clean:
        if vec_id % every or (vec_id, label, tuple(q)) in answered:
            continue
        answered.add((vec_id, label, tuple(q)))
        others = [(-int(v @ q), c, own == label) for j, c, own, v in clean if j != i and len(v) == len(q)]
        for score, positive, _ in sorted(x for x in others if x[2])[:positives]:
            hard = sorted((s, c) for s, c, same in others if not same and 80 * -score <= 100 * -s <= 100 * -score)[:k]
            out += [(vec_id, positive, rank, c, -score, -s) for rank, (s, c) in enumerate(hard, 1)]
    return Counter(out)


def mined(spark, rows, every):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("row", "cell", "shard", "dim", "v", "asks", "query"):
        vectors = vectors.withColumn(name, F.lit("clash"))
    got = multi_index.hard_negatives(vectors, F.col("vec_id") % every == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


def some(n, dim, seed, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    return [(i, (centers[i % 4] + spread * rng.normal(size=dim)).round(2).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture()
def small_cells(monkeypatch):
    monkeypatch.setattr(multi_index, "ROWS_PER_CELL", 8)
    monkeypatch.setattr(multi_index, "ROWS_PER_SHARD", 64)
    monkeypatch.setattr(multi_index, "FIRST_ROWS", 24)


CASES = {
    "random": some(700, 8, 1),
    "clustered": some(700, 8, 2, spread=0.15),
    "ties": [(i, [float(i % 3), 1.0, 0.5, 0.0], i % 2) for i in range(300)],
    "one vector has a third": some(300, 6, 3) + [(1000 + i, [1.0, 1.0, 0.5, 0.5, 0.25, 0.0], i % 5 == 0) for i in range(300)],
    "repeated rows": some(60, 4, 4) * 3,
    "one label": some(50, 4, 5, labels=1),
    "odd and short vectors": some(60, 5, 6) + [(200 + i, [float(i)], i % 2) for i in range(30)] + [(300 + i, [], i % 2) for i in range(8)],
    "unusable": [*some(60, 4, 7), (None, [1.0] * 4, 1), (70, None, 1), (80, [1.0] * 4, None), (90, [1.0, None, 1.0, 1.0], 1),
                 (100, [float("nan")] * 4, 1), (110, [float("inf")] * 4, 0), (120, [1.0] * 4, 0)],
    "single": [(0, [1.0, 2.0], 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_negatives_equal_brute_force(spark, small_cells, case):
    rows = [(vec_id, v, None if label is None else int(label)) for vec_id, v, label in CASES[case]]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_no_vectors(spark):
    assert not mined(spark, [], 10)


def test_cells_are_visited_in_falling_order():
    rng = random.Random(1)
    first, second = (np.array([rng.randint(-50, 50) for _ in range(n)]) for n in (9, 13))
    seen = list(multi_index.visited(first, second))
    assert len(seen) == len({(i, j) for _, i, j in seen}) == 9 * 13
    assert [b for b, _, _ in seen] == sorted((a + b for a in first for b in second), reverse=True)
    assert all(b == first[i] + second[j] for b, i, j in seen)
    assert [b for b, _, _ in multi_index.visited(first, second, 20)] == [b for b, _, _ in seen if b >= 20]


def test_bounds_hold_and_cells_are_skipped(spark, small_cells, monkeypatch):
    rows = some(4000, 8, 8, spread=0.05)
    vectors = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    stored = spark.createDataFrame([(i, i, label, 8, v.tolist()) for (i, _, label), v in zip(rows, vectors, strict=True)],
                                   "row long, vec_id long, label long, dim int, v array<long>")
    indexes, placed = multi_index.build(stored)
    index = indexes[8]
    cells = {r["row"]: r["cell"] for r in placed.collect()}
    assert sorted(cells) == list(range(4000)) and index.rows.sum() == 4000
    for q in range(0, 4000, 500):
        first, second = index.bounds(vectors[q])
        bound = (first[:, None] + second[None, :]).ravel()
        assert (vectors @ vectors[q] <= bound[[cells[i] for i in range(4000)]]).all()
        order = np.argsort([cells[i] for i in range(4000)], kind="stable")
        shard = multi_index.Shard(index, order, order, np.zeros(4000), np.array([cells[i] for i in order]), vectors[order])
        read = []
        monkeypatch.setattr(shard, "scores", lambda query, a, b: read.append(b - a) or vectors[order][a:b] @ query)
        (best,) = shard.best(q, 0, vectors[q], [-2**62], [2**62], True, -2**62, False, 5)
        score = vectors @ vectors[q]
        expected = sorted((-int(s), i, i) for i, s in enumerate(score) if i != q)[:5]
        assert best == expected
        assert sum(read) < 3000  # of 4000 rows
