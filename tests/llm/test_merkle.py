"""The Merkle manifest against a brute-force tree: nulls, repeated rows, one leaf, many languages, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayforge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """The top of ``nodes`` and, for each, the siblings left and right of it level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place - place % 8
            ways[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1:start + 8])))
            at[i] = place // 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: climb([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, world = climb([tops[lang][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        subroot, ways = tops[lang]
        for (_, _, leaf, row), way in zip(sorted(by_lang[lang], key=lambda x: x[:3]), ways, strict=True):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(row, text)
            for left, right in way + world[place]:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in way + world[place]))
            out.append((row[0], leaf, subroot, root, proof, folded, folded == root))
    return Counter(out)


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    words = ["The", "quick", "über", "漢字", "", "NOT", "end.\n", "x"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(langs), f"src{i % 3}", i) for i in range(n)]


CASES = {
    "one": [(5, "Only", "en", "s", 4)],
    "pair of languages": [(5, "Only", "en", "s", 4), (6, "Null", None, None, None)],
    "nulls and repeats": [*documents(30, ["en", "", None, "zz", "é"]), (None, None, None, None, None), (None, "A", "en", "s", 1),
                          (7, "Same", "en", "s", 4), (7, "Same", "en", "s", 4), (7, "Other", "en", "s", 5), (8, "", "en", "", 0),
                          (9, "X" * 300_000, "en", "s", 1), (-3, "Below", "en", "s", 1)],
    "several rounds": documents(1500, ["en", "en", "en", "de"]),
    "eight to the power": documents(512, ["en"]),
    "many languages": documents(1400, [f"l{i}" for i in range(700)]),
    "one row repeated": [(3, "Copy", "en", "s", 4)] * 900 + documents(20, ["en"]),
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_brute_force(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("place", "total", "grp", "root", "row", "leaf"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert Counter(map(tuple, merkle.verify(docs).collect())) == brute(rows)


def test_no_documents(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_and_own_change(spark):
    docs = spark.createDataFrame(documents(100, ["en", "de"]), SCHEMA)
    got = merkle.verify(docs, F.col("doc_id") == 11, F.lit("forged"), proofs=True).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [11]
    for r in got:
        node = r["leaf"]
        for level in r["proof"]:
            node = sha(level["left"] + node + level["right"])
        assert node == r["root"]


def test_versions_share_untouched_nodes():
    leaves = [sha(str(i)).encode() for i in range(100)]
    tree = merkle.PersistentTree(leaves, 3)
    base = list(tree.digests)
    tops = [tree.changed(tree.first, i, b"new") for i in (3, 42, 99)]
    assert tree.digests[:len(base)] == base
    assert len(tree.digests) == len(base) + 3 * 4  # a leaf and three ancestors each
    assert len({tree.digests[t] for t in [tree.first, *tops]}) == 4
    assert tree.digests[tree.changed(tops[0], 3, leaves[3])] == tree.digests[tree.first]
    assert tree.children[tops[2]][0] == tree.children[tree.first][0]  # leaves 0 to 63 lie under one shared node
    twice = tree.changed(tops[0], 42, b"new")
    assert climb([d.decode() for d in (*leaves[:3], b"new", *leaves[4:42], b"new", *leaves[43:])])[0] == tree.digests[twice].decode()
