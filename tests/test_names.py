"""Operators that add columns leave the caller's alone, whatever those are called."""

import pytest
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.operators import curves, features, losses, masking, ranking, sample, skew, split, views, vocabulary

CLASHING = ("_row _salt _salts _n _digest _bucket _inside _range _tokens _ids _w _choice _key _in0 _in1 _member _found _pos _at "
            "_pairs _names _all _score _clean _valid _masked n n_before token place position_before").split()


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, i % 7, f"k{i % 5}", i % 2, float(i % 10) / 10, ["a", "b", "a"][: i % 4], [2, 3, 0]) for i in range(60)]
    out = spark.createDataFrame(rows, "id long, grp long, k string, y int, p double, tokens array<string>, ids array<int>")
    return out.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([("k1", "one"), ("k2", "two")], "k string, v string")


def words(df):
    return vocabulary.build_vocabulary(df.select("tokens"), "tokens")


OPERATORS = {
    "spread_join": lambda df, keys: skew.spread_join(df, keys, ["k"], "left"),
    "lookup_join": lambda df, keys: skew.lookup_join(df, keys, ["k"], max_rows=0),
    "encode_tokens": lambda df, keys: vocabulary.encode_tokens(df, "tokens", words(df), "found"),
    "encode_by_join": lambda df, keys: vocabulary.encode_by_join(df, "tokens", words(df), "found"),
    "row_weights": lambda df, keys: losses.row_weights(df, "y"),
    "mask_tokens": lambda df, keys: masking.mask_tokens(df, "ids", key=["id"], vocab_size=9, seed=1),
    "hash_rank": lambda df, keys: ranking.hash_rank(df, key=["id"], seed=1),
    "hash_rank within": lambda df, keys: ranking.hash_rank(df, key=["id"], seed=1, within=["grp"]),
    "ordered_rank": lambda df, keys: ranking.ordered_rank(df, order=["id"]),
    "running_sums": lambda df, keys: ranking.running_sums(df, within=["grp"], order=F.col("id"), amounts=["y"]),
    "seeded_shuffle": lambda df, keys: sample.seeded_shuffle(df, key=["id"], seed=1),
    "batch_ids": lambda df, keys: sample.batch_ids(df, key=["id"], batch_size=8, seed=1),
    "flag_members": lambda df, keys: split.flag_members(df, ["k"], keys, "k"),
    "keep_members": lambda df, keys: split.keep_members(df, ["k"], keys, "k"),
    "drop_members": lambda df, keys: split.drop_members(df, ["k"], keys, "k"),
    "add_bits_vector": lambda df, keys: features.add_bits_vector(df, "ids", 8, out="vector"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_stay(df, keys, name):
    got = OPERATORS[name](df, keys)
    assert set(df.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    kept = {tuple(r) for r in got.select("id", *CLASHING).collect()}
    assert kept <= {tuple(r) for r in df.select("id", *CLASHING).collect()} and kept
    if name not in ("keep_members", "drop_members"):
        assert len(kept) == 60


def test_aggregates_ignore_other_columns(df):
    plain = df.drop(*CLASHING)
    assert curves.average_precision(df).collect() == curves.average_precision(plain).collect()
    one, two = (losses.masked_focal_loss(d, ["y"], ["p"], batch="grp").first()["loss"] for d in (df, plain))
    assert one == pytest.approx(two, rel=1e-12)
    records = plain.select(F.lit("CN").alias("smiles"), F.lit("C").alias("smiles_no_linker"), F.array("y").alias("binds"),
                           F.lit(0).alias("subset"), F.lit(1).alias("_clean"), F.lit(1).alias("_valid"))
    assert views.make_records(records, keep=["_clean"]).first()["_clean"] == 1


def test_fresh():
    assert fresh("a", ["b"], ["A", "_a"]) == "__a" and fresh("a") == "a"
