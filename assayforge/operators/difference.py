"""A stored checksum tree of a table, and the keys in which two tables differ.

A row belongs to the branch of its key's hash; a branch's digest is the number and the sum of the hashes of its
rows, so it depends neither on their order nor on how they are partitioned, and digests of shorter prefixes are
sums of longer ones'. Two trees are walked from the root: equal branches are left out with everything below
them, and row hashes are read from unequal ones alone, which file statistics find without a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.functions.hashing import hex_to_long, key_string

ROWS_PER_LEAF = 256
MOST_DIGITS = 8  # of a branch
HALF = 1 << 30  # row hashes have 60 bits
MOST_BRANCHES = 512  # unequal ones that the driver lists; beyond, the walk ends a level earlier and the rest is joined


def _digest() -> list[Column]:
    # Halves are summed as long integers, which costs a small part of decimal sums; they hold 2^33 rows a branch.
    low, high = F.sum(F.col("row_hash").bitwiseAND(HALF - 1)), F.sum(F.shiftright("row_hash", 30))
    total = (high.cast("decimal(19,0)") * F.lit(HALF).cast("decimal(10,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")
    return [F.count("*").alias("n"), total.alias("total")]


def write_tree(df: DataFrame, path: str, key: Sequence[str], columns: Sequence[str] | None = None) -> None:
    """Stores below ``path`` the row hashes of ``df`` in the order of their branches, and the digests of all branches.

    ``columns`` (by default, all) are what is compared, as text; nulls differ from empty values.
    """
    columns = df.columns if columns is None else columns
    row_hash = hex_to_long(F.substring(F.md5(key_string(*columns)), 1, 15))
    rows = df.select(F.substring(F.md5(key_string(*key)), 1, MOST_DIGITS).alias("branch"), F.struct(*key).alias("key"),
                     row_hash.alias("row_hash"))
    rows.repartitionByRange("branch", "row_hash").sortWithinPartitions("branch").write.mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    depth = min(MOST_DIGITS, max(0, math.ceil(math.log(max(1, stored.count()) / ROWS_PER_LEAF, 16))))
    leaves = stored.groupBy(F.substring("branch", 1, depth).alias("branch")).agg(*_digest())
    branch = F.substring(F.col("branch"), F.lit(1), F.col("level"))
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).groupBy("level", branch.alias("branch")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    # By ranges, so that a level with very many branches is written by many tasks.
    levels.repartitionByRange("level", "branch").sortWithinPartitions("level", "branch").write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")


def _below(branches: Sequence[str] | None) -> Column:
    """Whether ``branch`` lies below one of ``branches``; None stands for the root."""
    return F.lit(True) if branches is None else reduce(or_, [F.col("branch").startswith(b) for b in branches], F.lit(False))


def unequal_branches(spark: SparkSession, left: str, right: str, most: int = MOST_BRANCHES) -> tuple[list[str] | None, int]:
    """The lowest branches whose digests differ, as far as both trees go and no more than ``most`` are unequal.

    None stands for the root where even the first level has more; the second value is the number of levels read.
    """
    trees = [spark.read.schema("branch string, n long, total decimal(38,0), level int").parquet(f"{p}/tree") for p in (left, right)]
    depth = min(t.agg(F.max("level")).first()[0] or 0 for t in trees)
    found: list[str] | None = None
    for level in range(depth + 1):
        one, two = (t.where((F.col("level") == level) & _below(found)).select("branch", F.struct("n", "total").alias("digest")) for t in trees)
        both = one.withColumnRenamed("digest", "own").join(two.withColumnRenamed("digest", "other"), "branch", "full")
        here = [r["branch"] for r in both.where(~F.col("own").eqNullSafe(F.col("other"))).select("branch").limit(most + 1).collect()]
        if len(here) > most:
            return found, level + 1
        found = sorted(here)
        if not found:
            break
    return found, level + 1


def changed_keys(spark: SparkSession, left: str, right: str, most: int = MOST_BRANCHES) -> DataFrame:
    """(key..., change): the keys whose rows differ between two stored trees, ``added``, ``removed`` or ``changed``.

    A key with several rows is compared as a whole, rows in any order. Equal to a full comparison, up to
    collisions of 60-bit row hashes; only row hashes of unequal branches are read.
    """
    branches, _ = unequal_branches(spark, left, right, most)
    sides = []
    for path, name in ((left, "own"), (right, "other")):
        rows = spark.read.parquet(f"{path}/rows").where(_below(branches))
        sides.append(rows.groupBy("key").agg(*_digest()).select("key", F.struct("n", "total").alias(name)))
    both = sides[0].join(sides[1], "key", "full").where(~F.col("own").eqNullSafe(F.col("other")))
    change = F.when(F.col("own").isNull(), "added").when(F.col("other").isNull(), "removed").otherwise("changed")
    return both.select("key.*", change.alias("change"))
