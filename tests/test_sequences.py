import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayforge.functions import numeric
from assayforge.functions.sequences import (
    TEXT_PATTERN,
    bits_to_dense,
    pad,
    replace_linker,
    replace_pattern,
    target_field,
    tokenize,
)
from assayforge.functions.udfs import map_batches, safe_map
from assayforge.operators import masking, vocabulary


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [
    ("C[Dy]N", "C[H]N"), ("[Dy]O[Dy]", "[H]O[H]"), ("CCO", "CCO"), (None, None), ("", ""),
])
def test_linker(spark, text, expected):
    assert value(spark, replace_linker(F.lit(text).cast("string"))) == expected
    assert value(spark, replace_pattern(F.lit(text).cast("string"), r"\[Dy\]", "[H]")) == expected


@pytest.mark.parametrize("text,expected", [
    ("CClBr", ["C", "Cl", "Br"]), ("[C@@H](N)=O", ["[C@@H]", "(", "N", ")", "=", "O"]),
    ("c1cc%12", ["c", "1", "c", "c", "%12"]), ("", []), (None, None), ("C\\C/C", ["C", "\\", "C", "/", "C"]),
])
def test_molecule_tokens(spark, text, expected):
    assert value(spark, tokenize(F.lit(text).cast("string"))) == expected


def test_text_tokens_cover_every_character(spark):
    text = "Où est l'été ?\n\t42% – non\r\n"
    tokens = value(spark, tokenize(F.lit(text), TEXT_PATTERN))
    assert "".join(tokens) == "".join(c for c in text if c not in " \t\n\r")


@pytest.mark.parametrize("mode,size,expected", [
    ("error", 3, [1, 2, 3, 0, 0]), ("truncate", 7, [1, 2, 3, 4, 5]), ("drop", 7, None),
    ("keep", 7, [1, 2, 3, 4, 5, 6, 7]), ("error", 5, [1, 2, 3, 4, 5]), ("error", 0, [0] * 5),
])
def test_pad(spark, mode, size, expected):
    ids = F.array(*[F.lit(i + 1) for i in range(size)]).cast("array<int>")
    assert value(spark, pad(ids, 5, mode)) == expected


def test_pad_refuses_longer_sequences(spark):
    with pytest.raises(PySparkException, match="longer than 2"):
        value(spark, pad(F.array(F.lit(1), F.lit(2), F.lit(3)), 2))
    with pytest.raises(ValueError):
        pad(F.array(), 2, "other")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, ["a", "b", "b", "é"]), (1, ["zz", "a"]), (2, []), (3, None), (4, ["a"] * 50), (5, [" ", "b"])]
    return spark.createDataFrame(rows, "k long, tokens array<string>")


def test_vocabulary(texts):
    rows = vocabulary.build_vocabulary(texts, "tokens").orderBy("token_id").collect()
    assert [(r["token"], r["token_id"]) for r in rows] == [("a", 2), ("b", 3), ("zz", 4), ("é", 5)]
    frequent = vocabulary.build_vocabulary(texts, "tokens", min_frequency=2).collect()
    assert {r["token"] for r in frequent} == {"a", "b"}
    top = vocabulary.build_vocabulary(texts, "tokens", max_size=3).collect()
    assert {r["token"]: r["token_id"] for r in top} == {"a": 2, "b": 3, "zz": 4}


@pytest.mark.parametrize("max_lookup_rows", [1000, 1])
def test_encoding_by_lookup_and_by_join(texts, max_lookup_rows):
    vocab = vocabulary.build_vocabulary(texts, "tokens", min_frequency=2)
    got = vocabulary.encode_tokens(texts.repartition(3), "tokens", vocab, "ids", max_lookup_rows=max_lookup_rows)
    assert {r["k"]: r["ids"] for r in got.collect()} == {
        0: [2, 3, 3, 1], 1: [1, 2], 2: [], 3: None, 4: [2] * 50, 5: [1, 3]}


def test_join_encoding_keeps_copies(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 40, "tokens array<string>")
    vocab = vocabulary.build_vocabulary(df, "tokens")
    assert [r["ids"] for r in vocabulary.encode_by_join(df, "tokens", vocab).collect()] == [[2, 3]] * 40


def test_join_encoding_writes_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "PACKED_ITEMS", 500)
    rows = [(i, None if i % 50 == 0 else [f"token-{(i * j) % 97}" for j in range(i % 90)], [(str(i), i)], i / 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, Tokens array<string>, more array<struct<a: string, b: int>>, x double").coalesce(2)
    vocab = spark.createDataFrame([(f"token-{i}", 2 + i) for i in range(60)], "token string, token_id int")
    written, keep = [], vocabulary.pinned
    monkeypatch.setattr(vocabulary, "pinned", lambda held: (written.append(keep(held)), written[-1])[1])
    got = sorted((r["k"], r["Tokens"], [tuple(m) for m in r["more"]], r["x"], r["Tokens2"])
                 for r in vocabulary.encode_by_join(df, "tokens", vocab, "Tokens2").collect())
    known = {f"token-{i}": 2 + i for i in range(60)}
    assert got == [(*r, r[1] and [known.get(x, 1) for x in r[1]] if r[1] is not None else None) for r in rows]
    sizes = [len(r[0]) for r in written[0].collect()]
    assert len(sizes) > 10 and sum(sizes) < 150_000  # as rows the tokens alone take 24 bytes each, over 300,000


@pytest.fixture(scope="module")
def masked(spark):
    ids = F.concat(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: (i % 41 + 2).cast("int")),
                   F.array_repeat(F.lit(0), 38))
    df = spark.range(400).select("id", ids.alias("ids"))
    return masking.mask_tokens(df, "ids", key=["id"], vocab_size=43, rate=0.15, seed=42).cache()


def test_masking_outcomes(masked):
    rows = masked.select("id", F.posexplode(F.arrays_zip("ids", "masked", "target")).alias("pos", "e")).select(
        "pos", "e.ids", "e.masked", "e.target.label", "e.target.original").toPandas()
    padding = rows[rows.ids == 0]
    assert (padding.masked == 0).all() and (padding.label == -1).all()
    tokens = rows[rows.ids != 0]
    assert (tokens.original == tokens.ids).all()
    selected = tokens[tokens.label != -1]
    assert abs(len(selected) / len(tokens) - 0.15) < 0.01
    assert (selected.label == selected.ids).all()
    assert abs((selected.masked == 1).mean() - 0.8) < 0.02
    kept = tokens[tokens.label == -1]
    assert (kept.masked == kept.ids).all()
    drawn = selected[(selected.masked != 1) & (selected.masked != selected.ids)]
    assert drawn.masked.between(2, 42).all() and abs(len(drawn) / len(selected) - 0.1) < 0.02


def test_masking_is_repeatable_and_seeded(masked):
    df = masked.select("id", "ids")
    again = masking.mask_tokens(df.repartition(5), "ids", key=["id"], vocab_size=43, seed=42)
    other = masking.mask_tokens(df, "ids", key=["id"], vocab_size=43, seed=43)
    first = {r["id"]: r["masked"] for r in masked.collect()}
    assert {r["id"]: r["masked"] for r in again.collect()} == first
    assert {r["id"]: r["masked"] for r in other.collect()} != first


def test_selected_positions_and_target_fields(masked):
    rows = masking.selected_positions(masked, "target", "id")
    assert rows.where("label = -1 OR label <> original").count() == 0
    labels = masked.select(target_field(F.col("target"), "label").alias("l")).first()["l"]
    assert len(labels) == 128


def test_safe_map_policies(spark):
    def shout(s):
        if s == "bad":
            raise ValueError("bad")
        return s.upper()

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "s string")
    for policy, expected in (("null", ["OK", None, None]), ("keep", ["OK", "bad", None])):
        assert [r[0] for r in df.select(safe_map(shout, policy)("s")).collect()] == expected
    with pytest.raises(PySparkException):
        df.select(safe_map(shout, "fail")("s")).collect()
    with pytest.raises(ValueError):
        safe_map(shout, "ignore")


def test_map_batches(spark):
    def double(batch):
        return batch.assign(twice=batch["id"] * 2)

    got = map_batches(spark.range(10), double, "id long, twice long")
    assert all(r["twice"] == 2 * r["id"] for r in got.collect())


def test_numeric_helpers(spark):
    assert value(spark, numeric.clip(F.lit(7), 0, 1)) == 1
    assert value(spark, numeric.clip(F.lit(None).cast("int"), 0, 1)) is None
    assert value(spark, numeric.inverse_sqrt_weight(F.lit(0))) == 0.0
    assert value(spark, numeric.inverse_sqrt_weight(F.lit(4))) == 0.5
    assert value(spark, numeric.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert value(spark, numeric.one_hot(F.lit(9), 2)) == [0, 0]
    assert value(spark, numeric.ceil_div(F.lit(7), 3)) == 3
    assert [value(spark, numeric.categorical(F.lit(u), [0.5, 0.25, 0.25])) for u in (0.0, 0.5, 0.9)] == [0, 1, 2]
    assert value(spark, numeric.uniform_integer(F.lit(0.999), 2, 43)) == 42
    assert value(spark, bits_to_dense(F.array(F.lit(1), F.lit(3)), 4)) == [0, 1, 0, 1]
