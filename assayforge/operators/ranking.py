"""Numbering and cumulative sums over a whole DataFrame without a single-task window.

Hash order: the digest prefix gives uniform buckets, so the position of a row is the number of
rows in earlier buckets plus its place inside its own bucket. Value order: rows are split into
ranges of near-equal size first, and each range gets the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.functions.hashing import seeded_hash
from assayforge.functions.names import fresh
from assayforge.session import pinned

BUCKET_DIGITS = 4  # 16^4 = 65,536 buckets, so that many offset rows per group


def running_totals(counts: DataFrame, order: str, amounts: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Adds ``<amount>_before``: the total of the earlier rows of a small table."""
    window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*within, order, *[F.coalesce(F.sum(a).over(window), F.lit(0)).alias(a) for a in amounts])


def hash_rank(df: DataFrame, *, key: Sequence[str], seed: int | Column, out: str = "position",
              within: Sequence[str] = ()) -> DataFrame:
    """Adds the 1-based place of every row in the order of its seeded key hash.

    ``key`` must identify a row. ``within`` starts a new numbering per group. Rows are shuffled once,
    to their bucket; the offsets, one row per (group, bucket), join them there.
    """
    digest, bucket, place, n = (fresh(name, df, [out]) for name in ("_digest", "_bucket", "_inside", "_n"))
    marked = df.withColumn(digest, seeded_hash(*key, seed=seed)).withColumn(bucket, F.substring(digest, 1, BUCKET_DIGITS))
    counts = marked.groupBy(*within, bucket).agg(F.count("*").alias(n))
    offsets = running_totals(counts, bucket, [n], within)
    inside = Window.partitionBy(*within, bucket).orderBy(digest, *key)
    ranked = marked.withColumn(place, F.row_number().over(inside)).join(offsets, [*within, bucket])
    return ranked.withColumn(out, (F.col(n) + F.col(place)).cast("long")).select(*_kept(df, out), out)


def _kept(df: DataFrame, *out: str) -> list[str]:
    """The columns that stay where columns ``out`` are added or replaced."""
    return [c for c in df.columns if c.lower() not in {o.lower() for o in out}]


def _in_ranges(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds ``out``: the number of consecutive ranges of the ordering, written out so the numbers stay fixed."""
    return pinned(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def ordered_rank(df: DataFrame, *, order: Sequence[str], out: str = "position") -> DataFrame:
    """Adds the 1-based place of every row in the order of ``order``, which must identify a row."""
    part, place, n = (fresh(name, df, [out]) for name in ("_range", "_inside", "_n"))
    ranged = _in_ranges(df, [F.col(c) for c in order], part)
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    offsets = running_totals(counts, part, [n], [])
    inside = Window.partitionBy(part).orderBy(*order)
    ranked = ranged.withColumn(place, F.row_number().over(inside)).join(offsets, part)
    return ranked.withColumn(out, (F.col(n) + F.col(place)).cast("long")).select(*_kept(df, out), out)


def running_sums(df: DataFrame, *, within: Sequence[str], order: Column, amounts: Sequence[str]) -> DataFrame:
    """Adds ``<amount>_upto``: the running sum in ``order`` inside each group of ``within``.

    ``order`` must be unique inside a group. A group may hold most of the rows: it is spread over
    as many ranges as its size needs, and only (range, group) totals are summed in one place.
    """
    outs = [f"{a}_upto" for a in amounts]
    part = fresh("_range", df, outs)
    before = {a: fresh(f"_{a}_before", df, outs) for a in amounts}
    own = {a: fresh(f"_{a}_own", df, outs) for a in amounts}
    ranged = _in_ranges(df, [*[F.col(c) for c in within], order], part)
    totals = ranged.groupBy(*within, part).agg(*[F.sum(a).alias(before[a]) for a in amounts])
    offsets = running_totals(totals, part, list(before.values()), within)
    inside = Window.partitionBy(*within, part).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({own[a]: F.sum(a).over(inside) for a in amounts}).join(offsets, [*within, part])
    return summed.select(*_kept(df, *outs), *[(F.col(own[a]) + F.col(before[a])).alias(f"{a}_upto") for a in amounts])
