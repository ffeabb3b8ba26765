"""Deterministic sampling, splitting, shuffling and batching.

Exact sample sizes come from a hash cutoff: count rows per digest prefix, find the prefix in which
the wanted number is reached, look inside that prefix alone for the exact digest, then filter.
The data itself is never shuffled or sorted for it. ``key`` columns must identify a row; should
they not, all rows of one key fall on the same side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.functions.hashing import seeded_hash
from assayforge.functions.numeric import ceil_div
from assayforge.operators.ranking import hash_rank

# Prefix lengths of the successive counts: 4,096 prefixes, then 65,536 within the deciding one, then
# whole digests of what is left, one row in 2^28 on average.
_DIGITS = (3, 7, 32)


def hash_cutoffs(df: DataFrame, *, key: Sequence[str], seed: int, n: int | None = None,
                 fraction: float | None = None, label: str | None = None) -> dict:
    """``{class: digest of the last row to take}``; the only class is None without ``label``.

    Takes ``n`` rows per class, or ``ceil(fraction * rows)``; a smaller class is taken whole and a
    class with nothing to take is left out. One row per class and count comes to the driver.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    of_class = F.lit(None).cast("string") if label is None else F.col(label)
    digests = df.select(of_class.alias("label"), seeded_hash(*key, seed=seed).alias("digest"))
    by_class = Window.partitionBy("label")
    upto = by_class.orderBy("cutoff").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges: dict = {}
    for digits in _DIGITS:
        if edges:
            here = [(F.col("label").eqNullSafe(F.lit(c)), e) for c, e in edges.items()]
            rows = digests.where(reduce(or_, [same & F.col("digest").startswith(e.cutoff) for same, e in here]))
            wanted = F.coalesce(*[F.when(same, e.wanted - e.before) for same, e in here])
        else:
            rows = digests
            total = F.sum("n").over(by_class)
            wanted = F.lit(n) if n is not None else F.ceil(F.lit(fraction) * total)
            wanted = F.least(wanted, total)
        counts = rows.groupBy("label", F.substring("digest", 1, digits).alias("cutoff")).agg(F.count("*").alias("n"))
        sums = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("wanted", wanted.cast("long"))
        found = sums.where("upto >= wanted AND upto - n < wanted").withColumn("before", F.col("upto") - F.col("n"))
        edges = {row.label: row for row in found.collect()}
        if not edges:
            return {}
    return {c: e.cutoff for c, e in edges.items()}


def below_cutoff(key: Sequence[str | Column], seed: int, cutoff: str | None) -> Column:
    """Whether the row's digest is taken; nothing is without a cutoff."""
    return F.lit(False) if cutoff is None else seeded_hash(*key, seed=seed) <= cutoff


def balanced_sample(df: DataFrame, *, label: str, classes: Sequence, n: int, key: Sequence[str],
                    seed: int) -> DataFrame:
    """``n`` random rows of each listed class (all of a smaller class)."""
    wanted = df.where(F.col(label).isin(list(classes)))
    cutoffs = hash_cutoffs(wanted, key=key, seed=seed, n=n, label=label)
    taken = [(F.col(label) == c) & below_cutoff(key, seed, cutoff) for c, cutoff in cutoffs.items()]
    return wanted.where(reduce(or_, taken, F.lit(False)))


def balanced_sample_sql(path: str, *, label: str, classes: Sequence[int], n: int, key: str, seed: int) -> str:
    """The same sample as SQL over a Parquet path: one ordered, limited branch per class."""
    branches = [
        f"(SELECT * FROM parquet.`{path}` WHERE {label} = {value} "
        f"ORDER BY md5(concat_ws('|', CAST({key} AS STRING), '{seed}')) LIMIT {n})"
        for value in classes
    ]
    return " UNION ALL ".join(branches)


def row_split(df: DataFrame, *, key: Sequence[str], test_fraction: float, seed: int,
              out: str = "is_test") -> DataFrame:
    """Adds a flag that is true for exactly ``ceil(test_fraction * rows)`` random rows."""
    cutoff = hash_cutoffs(df, key=key, seed=seed, fraction=test_fraction).get(None)
    return df.withColumn(out, below_cutoff(key, seed, cutoff))


def seeded_shuffle(df: DataFrame, *, key: Sequence[str], seed: int, partitions: int | None = None) -> DataFrame:
    """Rows in a random order that depends only on key and seed, in ``partitions`` even parts."""
    order = [seeded_hash(*key, seed=seed), *[F.col(k) for k in key]]
    parts = [] if partitions is None else [partitions]
    return df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)


def epochs_in_order(df: DataFrame, *, key: Sequence[str], seed: int, epochs: int) -> DataFrame:
    """Every row once per epoch with its position in that epoch's own random order."""
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    per_epoch = F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"))
    return hash_rank(repeated, key=key, seed=per_epoch, out="position", within=["epoch"])


def batch_ids(df: DataFrame, *, key: Sequence[str], seed: int, batch_size: int) -> DataFrame:
    """Adds ``position`` in the seeded order and ``batch_id``, ``batch_size`` rows each."""
    ranked = hash_rank(df, key=key, seed=seed)
    return ranked.withColumn("batch_id", F.floor((F.col("position") - 1) / batch_size).cast("long"))


def batch_count(df: DataFrame, batch_size: int) -> DataFrame:
    return df.agg(ceil_div(F.count("*"), batch_size).alias("n_batches"))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Sources stacked by column name."""
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_by_name(*frames).distinct()
