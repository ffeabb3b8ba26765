"""Language identification against listed segmentations, and on texts of known language."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayforge.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def known():
    return langid.Pieces(PATH)


def segmentations(known, unit):
    """Every way to cut ``unit`` into pieces, as lists of piece numbers."""
    number = {p: i for i, p in enumerate(known.names)}
    if not unit:
        return [[]]
    out = []
    for end in range(1, len(unit) + 1):
        piece = number.get(unit[:end], known.unknown if end == 1 else None)
        if piece is not None:
            out += [[piece, *rest] for rest in segmentations(known, unit[end:])]
    return out


def table_of(known, languages, seed=1):
    table = np.random.default_rng(seed).random((known.unknown + 1, languages))
    return table / table.sum(0)


WORDS = ["the", "über", "a", "straße", "漢字", "ሀለ", "ciónes", "été", "zq"]


def test_a_word_is_the_sum_of_its_segmentations(known):
    table = table_of(known, 3)
    got = langid.log_probabilities(known, pa.array(WORDS), table)
    for word, logs in zip(WORDS, got, strict=True):
        ways = segmentations(known, langid.WORD_START + word)
        assert len(ways) > 1 or len(word) < 3
        for j in range(3):
            assert math.isclose(math.exp(logs[j]), sum(math.prod(table[p, j] for p in w) for w in ways), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_segmentations(known):
    table, lang, n = table_of(known, 2), np.arange(len(WORDS)) % 2, np.arange(1.0, len(WORDS) + 1)
    expected = np.zeros(table.shape)
    for word, own, times in zip(WORDS, lang, n, strict=True):
        ways = segmentations(known, langid.WORD_START + word)
        weight = np.array([math.prod(table[p, own] for p in w) for w in ways])
        for way, share in zip(ways, weight / weight.sum(), strict=True):
            for piece in way:
                expected[piece, own] += times * share
    np.testing.assert_allclose(langid.expected_counts(known, pa.array(WORDS), lang, n, table), expected, rtol=1e-9, atol=1e-12)


def test_long_words_are_cut_into_units(known):
    table = table_of(known, 2)
    long = "straße" * 11  # 67 characters with the mark: three units
    whole = langid.WORD_START + long
    got = langid.log_probabilities(known, pa.array([long, "x" * 100_000]), table)
    for j in range(2):
        ways = 0.0
        for start in range(0, len(whole), langid.UNIT):
            unit = whole[start:start + langid.UNIT]
            ahead = [1.0] + [0.0] * len(unit)
            number = {p: i for i, p in enumerate(known.names)}
            for a in range(len(unit)):
                for b in range(a + 1, len(unit) + 1):
                    piece = number.get(unit[a:b], known.unknown if b == a + 1 else None)
                    if piece is not None:
                        ahead[b] += ahead[a] * table[piece, j]
            ways += math.log(ahead[-1])
        assert math.isclose(got[0, j], ways, rel_tol=1e-9)
    assert np.isfinite(got).all()


def test_words_and_places():
    words, index, ends = langid.words_of(pa.array(["The, the über-Straße", "", "42 !", "a1b"]))
    named = words.to_pylist()
    assert [[named[i] for i in index[a:b]] for a, b in zip(ends, ends[1:])] == [["the", "the", "über", "straße"], [], [], ["a", "b"]]


VOICES = {"de": "der die und nicht ein zu haben werden ich über straße", "fr": "le la et pas un avoir être je été où",
          "es": "el la y no un haber ser yo año cómo"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(240):
        lang = list(VOICES)[i % 3]
        out.append((i, " ".join(rng.choices(VOICES[lang].split(), k=rng.randint(4, 40))).capitalize() + ".", lang, "s", 1))
    odd = [(300, None, "de", None, None), (301, "", "fr", None, 0), (302, "12 !? \n", "fr", None, 0), (303, "der " * 50_000, None, None, 0),
           (304, "ſ" * 5000, None, None, 0), (None, "le la être", "fr", None, 0), (305, "漢字", None, None, 0)]
    return [*out, *odd, out[0], out[0]]


def test_identify(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("lang_pred", "score", "word", "n", "piece"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = {}
    for r in langid.learn_and_identify(docs, PATH).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert sorted(map(str, got)) == sorted({str(r[0]) for r in rows})
    assert len(got[0]) == 3 and len(set(got[0])) == 1
    right = 0
    for doc_id, text, lang, *_ in rows[:240]:
        held, found, score = got[doc_id][0]
        assert held == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= score <= 1
        right += found == lang
    assert right >= 236
    assert [got[i][0][1:] for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303][0][1] == "de" and got[304][0][1] in VOICES and got[305][0][1] in VOICES
    assert got[None] == [(False, "fr", got[None][0][2])]


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(2, "der die", None, "s", 1), (3, None, None, "s", 1)], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in langid.learn_and_identify(docs, PATH).collect()} == {("und", 0.0)}
    assert langid.learn_and_identify(docs.limit(0), PATH).collect() == []


def test_labels_of_held_out_rows_teach_nothing(spark, rows):
    docs = spark.createDataFrame(rows[:240], SCHEMA)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    one, two = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.learn_and_identify(d, PATH).collect()} for d in (docs, other))
    assert one == two


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "a b", f"l{i}", "s", 1) for i in range(12)], SCHEMA)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, PATH, most_languages=10)
