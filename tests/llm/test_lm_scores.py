"""Scores against counts in a dictionary, with the filter whole and with the rarer pairs in segments of their own."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from assayforge.llm import lm

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    following = {f"w{i}": [f"w{rng.randrange(2500)}" for _ in range(3)] for i in range(2500)}
    out = []
    for i in range(400):
        word, words = f"w{rng.randrange(2500)}", []
        for _ in range(rng.randrange(1, 300)):
            words.append(word.upper() if rng.random() < 0.1 else word)
            word = rng.choice(following[word]) if rng.random() < 0.9 else f"w{rng.randrange(2500)}"
        out.append((i, " ".join(words)))
    return [*out, (400, None), (401, ""), (402, "never seen words here " * 3), (None, "w1 w2 w3"), out[5], out[5]]


def middle(n, least=2):
    """What the filter knows of a count."""
    return lm.expected_count(math.floor(math.log(n + 1e-9) / math.log(lm.BASE)) + 1) if n >= least else 0.0


def brute(rows, lowest=None, least=2):
    """The score of every row. Words below ``lowest`` are among the frequent ones here, so their counts are exact."""
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
    texts = [[*(t or "").lower().split(), None] for _, t in rows]
    words, pairs = Counter(), Counter()
    for out, own in zip(held, texts, strict=True):
        if not out:
            words.update(own)
            pairs.update(zip(["<start>", *own], own))
    scale = sum(words.values()) + 0.1 * (len(words) + 1)

    def count(word):
        if lowest is not None and middle(words[word], least) < lm.expected_count(lowest):
            return float(words[word])
        return middle(words[word], least)

    scores = []
    for own in texts:
        total = 0.0
        for before, word in zip(["<start>", *own], own):
            alone = (max(count(word), lm.UNSEEN) + 0.1) / scale
            n, u = middle(pairs[before, word], least), float(held.count(False)) if before == "<start>" else count(before)
            total += math.log10((n + lm.MASS * alone) / (max(u, n) + lm.MASS))
        scores.append(total)
    return scores


def by_row(spark, rows, **options):
    got = {}
    for r in lm.score(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    return got


def close(got, rows, want):
    """Differences per token of every row: a false positive of the filter changes a few of them."""
    return np.array([min(abs(g - w) for g in got[i]) / (len((t or "").split()) + 1) for (i, t), w in zip(rows, want, strict=True)])


def test_scores_are_those_of_the_counts(spark, rows):
    apart = close(by_row(spark, rows), rows, brute(rows))
    assert np.median(apart) < 0.01 and apart.mean() < 0.02 and (apart < 1e-9).mean() > 0.1


def test_a_filter_above_the_bound_loses_nothing(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = lm.gram_counts(docs.where(~lm.held_out(docs["doc_id"], 10))).cache()
    whole, none = lm.build_filter(counts)
    small, rare = lm.build_filter(counts, 1)
    assert none is None and whole.segments > 3 and whole.lowest == lm.LOWEST_LEVEL
    assert small.segments == 1 and small.lowest > lm.LOWEST_LEVEL + 1 and rare.segments > 1 and rare.pairs.count() > 3000
    got = by_row(spark, rows, most_segments=1)
    want = brute(rows, small.lowest)
    apart = close(got, rows, want)
    assert np.median(apart) < 0.01 and apart.mean() < 0.02
    cut = []  # what dropping the levels would give
    for own, total in zip(rows, want, strict=True):
        cut.append(abs(total - brute_without(rows, small.lowest, own)) / (len((own[1] or "").split()) + 1))
    assert np.mean(cut) > 0.1
    assert all(len(got[i]) == 3 and len({round(x, 9) for x in got[i]}) == 1 for i in (5,))


_KNOWN = {}


def brute_without(rows, lowest, own):
    """The score of one row if pairs below ``lowest`` were lacking."""
    if "pairs" not in _KNOWN:
        held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
        texts = [[*(t or "").lower().split(), None] for _, t in rows]
        words, pairs = Counter(), Counter()
        for out, mine in zip(held, texts, strict=True):
            if not out:
                words.update(mine)
                pairs.update(zip(["<start>", *mine], mine))
        _KNOWN.update(pairs=pairs, words=words, n=held.count(False), scale=sum(words.values()) + 0.1 * (len(words) + 1))
    words, pairs, least = _KNOWN["words"], _KNOWN["pairs"], lm.expected_count(lowest)
    total, before = 0.0, "<start>"
    for word in [*(own[1] or "").lower().split(), None]:
        n = middle(pairs[before, word])
        n = n if n >= least else 0.0
        u = float(_KNOWN["n"]) if before == "<start>" else float(words[before])
        alone = (max(float(words[word]), lm.UNSEEN) + 0.1) / _KNOWN["scale"]
        total += math.log10((n + lm.MASS * alone) / (max(u, n) + lm.MASS))
        before = word
    return total


@pytest.mark.parametrize("most_segments", [lm.MOST_SEGMENTS, 1])
def test_grams_seen_once_can_be_kept(spark, rows, most_segments):
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = lm.gram_counts(docs.where(~lm.held_out(docs["doc_id"], 10)), 1)
    model, rare = lm.build_filter(counts, most_segments, 1)
    assert (rare is None) == (most_segments > 1) and model.segments <= most_segments
    got = by_row(spark, rows, most_segments=most_segments, lowest=1)
    apart = close(got, rows, brute(rows, model.lowest if rare else None, 1))
    assert np.median(apart) < 0.015 and apart.mean() < 0.03


def test_nothing_to_score_or_learn_from(spark, rows):
    assert lm.score(spark.createDataFrame([], SCHEMA), most_segments=1).collect() == []
    only = [(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = lm.score(spark.createDataFrame(only, SCHEMA), most_segments=1).collect()
    assert len(got) == len(only) and all(math.isfinite(r["score"]) for r in got)


def test_the_query_keeps_pairs_seen_once(spark, rows, tmp_path):
    from assayforge.llm.queries import QUERIES

    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in QUERIES["op10_lm_scores"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    apart, without = (close(got, rows, brute(rows, None, least)) for least in (1, 2))
    assert np.median(apart) < 0.005 and apart.mean() < 0.015 and without.mean() > 4 * apart.mean()


def test_of_pairs_seen_once_those_that_another_text_asks_for_are_stored(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    held = lm.held_out(docs["doc_id"], 10)
    every = dict(lm.gram_counts(docs.where(~held), 1).collect())
    some = dict(lm.gram_counts(docs.where(~held), 1, docs.where(held)).collect())
    other = dict(lm.gram_counts(docs.where(held), 1).collect())
    assert some == {g: n for g, n in every.items() if n > 1 or g % 2 == 0 or g in other}
    assert any(g % 2 and n == 1 for g, n in some.items()) and len(some) < len(every)


@pytest.mark.parametrize("lowest", [1, 2])
def test_slices_and_bands_make_no_difference(spark, rows, monkeypatch, lowest):
    monkeypatch.setattr(lm, "SCORE_SLICE", 3000)
    monkeypatch.setattr(lm, "BAND_GRAMS", 2000)
    apart = close(by_row(spark, rows, lowest=lowest), rows, brute(rows, None, lowest))
    assert np.median(apart) < 0.01 and apart.mean() < 0.02


def test_a_slice_sends_its_grams_packed_one_row_a_band(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "SCORE_SLICE", 20000)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    cut = lm.sliced(docs, 10)
    sent = lm.slice_grams(cut, 8).collect()
    assert cut.count() > 5 and len(sent) == 8 * cut.count() == len({(r["slice"], r["band"]) for r in sent})
    counts = Counter()
    for r in sent:
        grams, adds = lm._unpacked([r["grams"]], np.uint64), lm._unpacked([r["adds"]], np.uint32)
        assert (np.diff(grams.astype(object)) > 0).all() and (grams >> np.uint64(61) == r["band"]).all() and len(grams) == len(adds)
        counts.update(dict(zip(grams.view(np.int64).tolist(), (adds >> 1).tolist(), strict=True)))
    want = dict(lm.gram_counts(docs.where(~lm.held_out(docs["doc_id"], 10)), 1).collect())
    assert {g: n for g, n in counts.items() if n} == want


def test_words_that_training_lacks_count_nothing_past_the_bound(spark, rows):
    new = [(i, f"unseen{i} other{i}") for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [*rows, *new]
    docs = spark.createDataFrame(rows, SCHEMA)
    small, rare = lm.build_filter(lm.gram_counts(docs.where(~lm.held_out(docs["doc_id"], 10))), 1)
    got, want = by_row(spark, rows, most_segments=1), brute(rows, small.lowest)
    assert rare is not None and len(new) > 5
    assert np.median([abs(got[i][0] - w) for (i, _), w in zip(rows[-len(new):], want[-len(new):], strict=True)]) < 1e-9
