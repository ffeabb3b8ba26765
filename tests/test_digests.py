"""Digests of many texts at once, and the operators that draw and hash by them, against one digest at a time."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from assayforge.functions.digests import byte_part, md5_words
from assayforge.functions.udfs import list_slices
from assayforge.operators import difference, vocabulary
from assayforge.operators.fingerprint import token_fingerprint
from assayforge.operators.masking import mask_tokens


def word(text: str, k: int = 0) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * k:8 * k + 8], 16)


def test_words_are_those_of_md5():
    rng = random.Random(3)
    texts = ["é" * (n // 2) + "x" * (n % 2) for n in (0, 1, 54, 55, 56, 63, 64, 65, 200)]
    texts += ["".join(rng.choice("abc|é") for _ in range(rng.randrange(80))) for _ in range(9000)]
    index = np.arange(len(texts))
    got = md5_words(byte_part([t.encode() for t in texts], index), byte_part([b"", b"|7"], index % 2))
    want = [[word(t + ["", "|7"][i % 2], k) for k in (0, 1)] for i, t in enumerate(texts)]
    assert got.tolist() == want
    assert md5_words(byte_part([], np.arange(0))).shape == (0, 2)


def test_long_batches_are_cut_between_rows():
    rows = pa.array([[1] * n for n in (3, 0, 9, 1, 1)] + [None, [1] * 4], pa.list_(pa.int32()))
    assert list(list_slices(rows.slice(1), 4)) == [(0, 1), (1, 5), (5, 6)]
    assert list(list_slices(rows.slice(0, 0), 4)) == []


def fingerprint_of(tokens, radius=2, n_bits=64):
    bits, nulls = set(), False
    for r in range(radius + 1):
        for i, token in enumerate(tokens or []):
            if r == 0 and token is None:
                nulls = True
                continue
            text = " ".join(t for t in tokens[max(i - r, 0):i + r + 1] if t is not None)
            bits.add(word(f"{r}|{text}") % n_bits)
    return sorted(bits) + [None] * nulls


def test_fingerprints_are_hashed_once_a_distinct_window(spark):
    rows = [(0, ["C", "N", "C", "N", "C"]), (1, []), (2, None), (3, ["x", None, None, "é" * 40]), (4, ["C", "N", "C", "N", "C"]),
            (5, [None]), (6, ["", " ", "C"])]
    df = token_fingerprint(spark.createDataFrame(rows, "k int, tokens array<string>").coalesce(1), "tokens", n_bits=64)
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: (r["bits"], r["is_valid"]) for r in df.collect()}
    assert got == {k: (fingerprint_of(t), bool(t)) for k, t in rows}


def test_masks_are_drawn_by_row_and_position(spark):
    rows = [(f"k{i}" * (1 + i % 30) if i else None, [2 + (i + j) % 9 if j % 7 else 0 for j in range(i % 12)]) for i in range(300)]
    rows += [("n", None), ("m", [5, None, 0, 7])]
    df = mask_tokens(spark.createDataFrame(rows, "k string, ids array<int>"), "ids", key=["k"], vocab_size=11, seed=5, rate=0.5)
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    outcomes = set()
    for r in df.collect():
        if r["ids"] is None:
            assert r["masked"] is None and r["target"] is None
            continue
        for i, token in enumerate(r["ids"]):
            text = f"{'~' if r['k'] is None else r['k']}|{i}|5"
            u, v = word(text) / 2**32, word(text, 1) / 2**32
            kept = token == 0 or u < 0.5
            shown = token if kept else 1 if u < 0.9 else 2 + int(v * 9) if u < 0.95 else token
            outcomes.add(0 if kept else 1 if u < 0.9 else 2 if u < 0.95 else 3)
            assert r["masked"][i] == shown and r["target"][i]["original"] == token
            assert r["target"][i]["label"] == (-1 if kept else token)
    assert outcomes == {0, 1, 2, 3}


def test_a_joined_vocabulary_sees_each_distinct_token_of_a_row_once(spark, monkeypatch):
    rows = [(i, [f"t{(i * j) % 13}" for j in range(40)]) for i in range(50)] + [(50, []), (51, None), (52, ["t1", None, "t1", None, "u"]), (0, ["t1"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([(f"t{i}", 2 + i) for i in range(12)], "token string, token_id int")
    joined, asked = vocabulary.spread_join, []
    monkeypatch.setattr(vocabulary, "spread_join", lambda left, *a, **k: (asked.append(left), joined(left, *a, **k))[1])
    got = sorted((r["k"], r["tokens"], r["ids"]) for r in vocabulary.encode_by_join(df, "tokens", vocab).collect() if r["tokens"])
    known = {f"t{i}": 2 + i for i in range(12)}
    assert got == sorted((k, t, [known.get(x, 1) for x in t]) for k, t in rows if t)
    assert asked[0].count() == sum(len(set(t or [])) for _, t in rows)
    assert "collect_list" not in asked[0]._jdf.queryExecution().executedPlan().toString()  # no shuffle before the join


def test_branch_digests_are_exact_sums(spark):
    largest = 2**60 - 1
    df = spark.createDataFrame([(largest,)] * 40 + [(5,), (0,)], "row_hash long")
    got = df.agg(*difference._digest())
    assert got.first() == (42, 40 * largest + 5)
    assert dict(got.dtypes)["total"] == "decimal(38,0)"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sum(cast(row_hash" not in plan  # decimals are made once a branch, not once a row
