import math

import pytest
from pyspark.sql import functions as F

from assayforge.functions.hashing import seeded_hash
from assayforge.operators import quality, sample, split
from assayforge.operators.ranking import hash_rank, ordered_rank, running_sums

BLOCKS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def blocks(spark):
    """A third of the rows share one block; some blocks are null."""
    n = F.col("id")
    return spark.range(3000).select(
        "id", F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), n % 211)).alias("x"),
        F.concat(F.lit("b"), n % 97).alias("y"),
        F.when(n % 10 != 0, F.concat(F.lit("c"), n % 53)).alias("z"),
    )


def by_hash(values, seed):
    import hashlib
    return sorted(values, key=lambda v: hashlib.md5(f"{v}|{seed}".encode()).hexdigest())


@pytest.mark.parametrize("fraction,seed", [(0.03, 42), (0.5, 1), (1.0, 2), (0.0001, 3)])
def test_held_out_count_and_choice(blocks, fraction, seed):
    distinct = {v for r in blocks.collect() for v in (r["x"], r["y"], r["z"]) if v is not None}
    held = {r["block"] for r in split.held_out_keys(blocks, BLOCKS, fraction=fraction, seed=seed).collect()}
    assert held == set(by_hash(distinct, seed)[: math.ceil(fraction * len(distinct))])


def test_group_split_has_no_leakage_and_flags_every_touching_row(blocks):
    held = split.held_out_keys(blocks, BLOCKS, seed=7)
    names = {r["block"] for r in held.collect()}
    rows = split.group_split(blocks, BLOCKS, seed=7).collect()
    for r in rows:
        assert r["subset"] == int(bool({r["x"], r["y"], r["z"]} & names))
    row = split.leakage(split.group_split(blocks, BLOCKS, seed=7), BLOCKS, held).first()
    assert row["n_leaked"] == 0 and row["n_train"] + row["n_validation"] == 3000


def test_group_split_does_not_shuffle_the_rows(blocks):
    plan = split.group_split(blocks, BLOCKS, seed=7)._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Join" not in main and "Repartition" not in main


def test_split_is_stable_under_repartitioning(blocks):
    one = split.group_split(blocks, BLOCKS, seed=7).orderBy("id").collect()
    two = split.group_split(blocks.repartition(13), BLOCKS, seed=7).orderBy("id").collect()
    assert one == two


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_membership_by_broadcast_and_by_spread_join(spark, blocks, monkeypatch, limit):
    monkeypatch.setattr(split, "fits_broadcast", lambda df: df.count() <= limit)
    keys = spark.createDataFrame([("hot",), ("b1",), ("c5",), ("none",), (None,)], "k string")
    flagged = split.flag_members(blocks, BLOCKS, keys, "k")
    names = {"hot", "b1", "c5"}
    rows = flagged.collect()
    assert len(rows) == 3000
    assert all(r["is_member"] == bool({r["x"], r["y"], r["z"]} & names) for r in rows)
    kept = split.keep_members(blocks, BLOCKS, keys, "k").count()
    assert kept + split.drop_members(blocks, BLOCKS, keys, "k").count() == 3000


def test_shared_and_overlap(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert [r["k"] for r in split.shared_keys(left, right, "k").collect()] == [2]
    size = spark.range(1).select(split.overlap_size(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()[0]
    assert size == 1


@pytest.mark.parametrize("n", [0, 1, 17, 250, 5000])
def test_balanced_sample_is_exact(spark, n):
    df = spark.range(4000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = sample.balanced_sample(df, label="y", classes=[0, 1], n=n, key=["id"], seed=3).collect()
    for value, size in ((0, 3600), (1, 400)):
        ids = {r["id"] for r in rows if r["y"] == value}
        pool = [r["id"] for r in df.where(F.col("y") == value).collect()]
        assert ids == set(by_hash(pool, 3)[: min(n, size)])


def test_sql_sample_equals_operator(spark, tmp_path):
    path = str(tmp_path / "long")
    spark.range(500).withColumn("y", (F.col("id") % 5 == 0).cast("int")).write.parquet(path)
    by_sql = spark.sql(sample.balanced_sample_sql(path, label="y", classes=[0, 1], n=30, key="id", seed=9))
    by_operator = sample.balanced_sample(spark.read.parquet(path), label="y", classes=[0, 1], n=30, key=["id"], seed=9)
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_operator.collect()))


def test_row_split_is_exact(spark):
    df = spark.range(1003)
    assert sample.row_split(df, key=["id"], test_fraction=0.2, seed=42).where("is_test").count() == math.ceil(0.2 * 1003)
    assert sample.row_split(df, key=["id"], test_fraction=0.0, seed=42).where("is_test").count() == 0


def test_hash_rank_is_the_hash_order(spark):
    ranked = hash_rank(spark.range(2000), key=["id"], seed=5).collect()
    place = {r["id"]: r["position"] for r in ranked}
    assert [place[i] for i in by_hash(range(2000), 5)] == list(range(1, 2001))


def test_epochs_differ_and_are_permutations(spark):
    rows = sample.epochs_in_order(spark.range(200), key=["id"], seed=1, epochs=3).collect()
    orders = [[r["id"] for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: r["position"])] for e in range(3)]
    assert all(sorted(o) == list(range(200)) for o in orders)
    assert len({tuple(o) for o in orders}) == 3


def test_shuffle_keeps_the_multiset_and_moves_rows(spark):
    df = spark.range(1000)
    shuffled = sample.seeded_shuffle(df, key=["id"], seed=11, partitions=20)
    assert shuffled.rdd.getNumPartitions() == 20
    assert quality.checksum(shuffled, ["id"]).first() == quality.checksum(df, ["id"]).first()
    order = [r["id"] for r in shuffled.collect()]
    assert order == by_hash(range(1000), 11)
    assert max(shuffled.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 150


def test_batches(spark):
    rows = sample.batch_ids(spark.range(1000), key=["id"], seed=2, batch_size=64).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in rows) == [1000 % 64] + [64] * 15
    assert sample.batch_count(spark.range(1000), 64).first()["n_batches"] == 16


def test_ordered_rank(spark):
    words = spark.createDataFrame([(w,) for w in ["b", "a", "é", "Z", "aa", "~"]], "w string")
    got = {r["w"]: r["position"] for r in ordered_rank(words, order=["w"]).collect()}
    assert sorted(got, key=got.get) == sorted(got, key=lambda w: w.encode())


def test_running_sums_over_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, "hot").otherwise("rest").alias("g"), "id",
                                  (F.col("id") % 7).alias("v"))
    rows = running_sums(df, within=["g"], order=F.desc("id"), amounts=["v"]).orderBy(F.desc("id")).collect()
    total = {"hot": 0, "rest": 0}
    for r in rows:
        total[r["g"]] += r["v"]
        assert r["v_upto"] == total[r["g"]]


def test_seeded_hash_separates_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(seeded_hash("x", "y", seed=1).alias("h")).distinct().count() == 2


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("x", 1)], "v string, k int")
    assert sample.union_by_name(a, b).count() == 2
    assert sample.union_distinct(a, b).count() == 1
