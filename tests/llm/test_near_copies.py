"""Near copies against exact similarity of all pairs: planted copies, unlike texts, short and empty ones, hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge.llm import near_copies as near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprstvw" for b in ("an", "el", "io", "um", "ar", "est")]


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    return set(near.shingle_hashes(words_of(text)).tolist())


def changed(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(VOCABULARY).upper()
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    own = [text(rng.randint(30, 400)) for _ in range(120)]
    out = list(own)
    for i, t in enumerate(own[:60]):  # up to 2 % of the words: similarity 0.82 or more
        out += [changed(rng, t, max(1, len(t.split()) // 50)) for _ in range(1 + i % 4)]
    out += [own[3].upper(), own[3].replace(" ", "\n "), own[5], own[5], "", None, " \n", "one two", "One\ttwo", "one two three",
            text(30_000), "x" * 5000]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)] + [(None, own[9], "en", "s", 1), (7, own[100], "en", "s", 1)]


def brute_groups(rows, similarity=0.8):
    found = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if not found[i] and not found[j] or len(found[i] & found[j]) >= similarity * max(1, len(found[i] | found[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_groups_are_those_of_all_pairs(spark, rows):
    """No two unlike texts meet; of the near copies a few in a hundred may be missed."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("node", "root", "place", "key", "_id")}).repartition(3)
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    expected, copies = [], 0
    for members in brute_groups(rows):
        least = min(((rows[i][0] is None, rows[i][0] or 0) for i in members))
        expected.append(None if least[0] else least[1])
        copies += len(members) - 1
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert set(expected) <= set(got)
    assert len(got) - len(expected) <= 0.03 * copies


def test_no_documents(spark):
    assert near.without_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_original_with_many_near_copies(spark, monkeypatch):
    """Copies are less alike among each other than to their original; chunks of a hot key meet each other."""
    monkeypatch.setattr(near, "TILE", 64)
    rng = random.Random(5)
    original = " ".join(rng.choices(VOCABULARY, k=220))
    texts = [original, *(changed(rng, original, 4) for _ in range(400))]
    assert all(len(shingles(t) & shingles(original)) >= 0.8 * len(shingles(t) | shingles(original)) for t in texts)
    assert len(shingles(texts[1]) & shingles(texts[2])) < 0.8 * len(shingles(texts[1]) | shingles(texts[2]))
    texts += [" ".join(rng.choices(VOCABULARY, k=220)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in near.without_near_copies(docs).collect()}
    assert {0, *range(401, 431)} <= kept
    assert len(kept) - 31 <= 0.03 * 400  # far fingerprints


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1100).astype(np.uint64)
    one, two = near.sketch(pool[:1000]), near.sketch(pool[100:])
    alike = (np.frombuffer(one, np.uint8) == np.frombuffer(two, np.uint8)).mean()
    assert abs(alike - 900 / 1100) < 0.1
    assert near.sketch(pool) == near.sketch(pool[::-1]) and len(near.sketch(pool[:0])) == near.SLOTS


def test_links_join_what_is_alike():
    rng = np.random.default_rng(4)
    signs = rng.integers(0, 256, (60, near.SLOTS)).astype(np.uint8)
    for i in range(60):  # a chain of thirds: each like the one before it
        if i % 3:
            signs[i, :200] = signs[i - 1, :200]
    bits = np.zeros((60, 64), np.uint8)
    bits[:, :60] = 1 - np.eye(60, dtype=np.uint8)
    links = near.alike_links(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), signs, 0.6)
    root = list(range(60))
    for i, j in links:
        root = [root[i] if r == root[j] else r for r in root]
    assert all((root[i] == root[j]) == (i // 3 == j // 3) for i in range(60) for j in range(60))
    assert len(links) <= 2 * 60


@pytest.mark.parametrize("radius", [0, 1, 7, 28])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, (700, 2)).astype(np.uint64)
    for i in range(100, 300):  # some near ones
        fps[i] = fps[i - 100]
        for bit in rng.integers(0, 128, rng.integers(0, 40)):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    found = near.near_rows(fps[:, 0], fps[:, 1], radius)
    bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :700].astype(bool)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
    assert (bits == (apart <= radius)).all()


@pytest.mark.parametrize("nodes", [0, 1000, 10**7, 10**11])
def test_tables_follow_the_number_of_nodes(nodes):
    tables = near.sampled_bits(nodes)
    size = len(tables[0])
    assert size >= near.LEAST_BITS and nodes / 2**size <= 8 * near.NODES_PER_KEY
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        differ = set(rng.permutation(near.FINGERPRINT)[:near.FAR].tolist())
        hits += any(not differ & set(bits) for bits in tables)
    assert hits >= 0.9 * 300
