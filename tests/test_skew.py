import pytest
from pyspark.sql import functions as F

from assayforge.operators.skew import fits_broadcast, hot_keys, lookup_join, spread_join


@pytest.fixture(scope="module")
def facts(spark):
    """Two thirds of 6,000 rows share one key; some rows have no partner, some no key."""
    n = F.col("id")
    key = F.when(n % 3 != 0, F.lit(-1)).when(n % 60 == 0, F.lit(None)).otherwise(n)
    return spark.range(6000).select("id", key.cast("long").alias("k"))


@pytest.fixture(scope="module")
def dims(spark):
    return spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


def test_hot_keys_are_few(facts):
    assert [r["k"] for r in hot_keys(facts, ["k"]).collect()] == [-1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(facts, dims, how):
    spread = spread_join(facts, dims, ["k"], how).select("id", "k", "v").collect()
    plain = facts.join(dims, ["k"], how).select("id", "k", "v").collect()
    assert sorted(map(str, spread)) == sorted(map(str, plain))


def test_spread_join_deals_the_hot_key(spark, facts, dims):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(facts, dims, ["k"]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) >= 4000 and max(sizes) < 2000


def test_lookup_join_both_ways(facts, dims):
    small = lookup_join(facts, dims, ["k"]).select("id", "v").collect()
    large = lookup_join(facts, dims, ["k"], max_rows=10).select("id", "v").collect()
    assert sorted(map(str, small)) == sorted(map(str, large))
    assert fits_broadcast(dims, 4001) and not fits_broadcast(dims, 4000)


def test_long_texts_do_not_fit(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits_broadcast(wide, max_bytes=10_000) and not fits_broadcast(wide, max_bytes=9_999)
    assert fits_broadcast(wide.limit(0))
    nested = spark.range(10).select(F.array_repeat("id", 1000).alias("a"))
    assert not fits_broadcast(nested, max_bytes=10_000)


def test_identical_rows_of_a_hot_key_are_dealt(spark, dims):
    same = spark.range(6000).select(F.lit(7).cast("long").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(same, dims, ["k"]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 6000 and max(sizes) < 3000
