"""Cutoffs against a brute-force choice, and how often a simulated stratum loses more than the risk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge.llm import quality_rules as rules


def chosen(good, bad, risk=rules.RISK, level=rules.LEVEL, price=rules.PRICE):
    """The cutoff of a stratum from the worst buckets of its good and bad texts."""
    good, bad, best = np.asarray(good), np.asarray(bad), None
    for k in range(rules.STEPS - 1, 0, -1):  # from the most lenient one on, until one fails
        lost = int((good > k).sum())
        tail = math.fsum(math.comb(len(good), i) * risk**i * (1 - risk) ** (len(good) - i) for i in range(lost + 1))
        if tail > level / len(rules.BANDS):
            break
        gain = int((bad > k).sum()) * len(good) - price * lost * len(bad)
        if gain > 0 and (best is None or gain > best[0]):
            best = gain, k
    return None if best is None else best[1]


def measured_rows(rng, n, stratum, shift):
    """(doc_id, text_hash, n_words, word_chars, n_symbols, ...) whose share of symbols is drawn."""
    share = np.clip(rng.beta(1 + shift, 12, n) * 32, 0, 32).round() / 32
    return [(int(rules.BANDS[stratum]) + 1, 320, int(s * 320)) for s in share]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for stratum, (n_good, n_bad) in enumerate([(900, 200), (200, 60), (147, 30), (100, 30)]):
        for quality, n, shift in ((1, n_good, 0), (0, n_bad, 8)):
            for words, chars, symbols in measured_rows(rng, n, stratum, shift):
                rows.append((len(rows), len(rows), words, chars, symbols, 0, 5, 0, 0))
                labels.append((rows[-1][0], quality))
    # Copies of one bad text, labelled good: one trial however many they are.
    copies = [(len(rows) + i, -1, rules.BANDS[0] + 1, 320, 200, 0, 5, 0, 0) for i in range(400)]
    schema = ("doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, "
              "n_dup_lines long, n_repeat_words long")
    return (spark.createDataFrame(rows + copies, schema),
            spark.createDataFrame(labels + [(r[0], 1) for r in copies], "doc_id long, quality int"))


def test_cutoffs_equal_a_brute_force_choice(table):
    measured, labels = table
    rows = measured.join(labels, "doc_id").withColumns({"stratum": rules.stratum(), "worst": rules.worst()}).toPandas()
    rows = rows.drop_duplicates(["text_hash"])
    expected = {}
    for stratum, own in rows.groupby("stratum"):
        cut = chosen(own.worst[own.quality == 1], own.worst[own.quality == 0])
        if cut is not None:
            expected[stratum] = cut
    assert expected and 3 not in expected  # a hundred good documents certify nothing
    assert {r["stratum"]: r["cut"] for r in rules.cutoffs(measured, labels).collect()} == expected


def test_a_stratum_seldom_loses_more_than_the_risk():
    rng = np.random.default_rng(3)
    failures, active, trials = 0, 0, 400
    weights = 0.8 ** np.arange(33)
    weights /= weights.sum()
    for _ in range(trials):
        good, bad = rng.choice(33, 600, p=weights), rng.integers(10, 33, 100)
        cut = chosen(good, bad, price=0)  # the greediest choice among the safe ones
        active += cut is not None
        failures += cut is not None and weights[cut + 1:].sum() > rules.RISK
    assert active > 0.9 * trials and failures <= rules.LEVEL * trials


def test_rules_judge_by_any_share(spark):
    plain = "some plain words of a text that has nothing to object to in it at all and goes on for a while"
    texts = [(i, f"{plain} number {i} {i * 3} {i * 7}", 1) for i in range(400)]
    texts += [(1000 + i, f"{plain.upper()} NUMBER {i}", 0) for i in range(60)]
    texts += [(2000 + i, " ".join(f"$$$%% {w} ###" for w in plain.split()) + f" {i}", 0) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, docs).collect()}
    assert all(kept[i] == (i < 1000) for i in kept)
    unlabelled = docs.withColumn("quality", F.lit(None).cast("int"))
    assert rules.judge(docs, unlabelled).where("kept = base_failed").count() == 0
