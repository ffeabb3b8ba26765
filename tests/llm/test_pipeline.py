"""The whole pipeline on a planted corpus: what each stage has to do to it, and every id of what stays, packed once."""

import random

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


@pytest.fixture(scope="module")
def corpus():
    """(documents, labels, texts that have to be left by doc_id)."""
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choices(VOCABULARY, k=n)) + "."
    docs, labels, left = {}, {}, {}
    for i in range(0, 120):  # clean ones, in lines of their own
        docs[i] = left[i] = "\n".join(line(rng.randint(9, 14)) for _ in range(rng.randint(2, 5)))
        labels[i] = 1
    for i in range(120, 200):  # junk, labelled and not
        docs[i] = "\n".join(f"{'BUY!!! ' * rng.randint(5, 9)}$$$ {i} ###" for _ in range(3))
        if i < 180:
            labels[i] = 0
    passage = "\n".join(line(14) for _ in range(5))  # of 70 words, in three documents
    for i in (200, 201, 202):
        own = line(12)
        docs[i] = f"{own}\n{passage}\n{line(12)}"
        left[i] = docs[i] if i == 200 else "\n".join([own, docs[i].split("\n")[-1]])
    long = line(240)
    docs[210] = left[210] = long
    words = long.split()
    for i in (211, 212):  # near copies of one line, similarity 0.9
        other = list(words)
        for at in rng.sample(range(len(words)), 2):
            other[at] = "changed"
        docs[i] = " ".join(other)
    docs[220] = f"{line(12)}\nthe deploy token = q7Zt9LmX2vB8nK4jH6dS1aPw is set here\n{line(12)}"
    left[220] = docs[220].replace("token = q7Zt9LmX2vB8nK4jH6dS1aPw", "[SECRET]")
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in docs.items()]
    return rows, [(i, q, 0) for i, q in labels.items()], left


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect_and_every_id_is_packed_once(spark, tmp_path, corpus):
    from tokenizers import Tokenizer

    rows, labels, left = corpus
    written(spark, tmp_path, rows, labels)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    got = {i: sum((ids for _, ids in sorted(own)), []) for i, own in pieces.items()}
    assert sorted(got) == sorted(want)
    assert {i: ids for i, ids in got.items() if ids != want[i]} == {}
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
        assert sum(n for _, n in own) <= 4096


def test_stages_of_no_documents(spark, tmp_path, corpus):
    rows, labels, _ = corpus
    written(spark, tmp_path / "none", [], [])
    assert entry_point.queries()["pipeline"](spark, str(tmp_path / "none")).collect() == []
    written(spark, tmp_path / "unlabelled", rows[:5], [])
    assert len({r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "unlabelled")).collect()}) == 5
