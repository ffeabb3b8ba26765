"""Group-aware validation split over several key columns, and membership in a key set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.operators.sample import below_cutoff, hash_cutoffs
from assayforge.functions.names import fresh
from assayforge.operators.skew import fits_broadcast, hot_keys, spread_join
from assayforge.schemas import TRAIN, VALIDATION
from assayforge.session import pinned

HELD_OUT_FRACTION = 0.03


def distinct_keys(df: DataFrame, columns: Sequence[str], out: str = "block") -> DataFrame:
    """Distinct non-null values over the union of several columns."""
    return (
        df.select(F.explode(F.array(*columns)).alias(out)).where(F.col(out).isNotNull()).distinct()
    )


def held_out_cutoff(df: DataFrame, columns: Sequence[str], *, fraction: float = HELD_OUT_FRACTION,
                    seed: int) -> str | None:
    """Digest up to which keys are held out; the distinct keys are gathered once."""
    keys = pinned(distinct_keys(df, columns))
    return hash_cutoffs(keys, key=["block"], seed=seed, fraction=fraction).get(None)


def held_out_keys(df: DataFrame, columns: Sequence[str], *, fraction: float = HELD_OUT_FRACTION, seed: int,
                  out: str = "block") -> DataFrame:
    """``ceil(fraction * n)`` of the ``n`` distinct keys, chosen by seeded hash."""
    keys = pinned(distinct_keys(df, columns, out))
    cutoff = hash_cutoffs(keys, key=[out], seed=seed, fraction=fraction).get(None)
    return keys.where(below_cutoff([out], seed, cutoff))


def any_held_out(columns: Sequence[str], seed: int, cutoff: str | None) -> Column:
    """Whether any key column is held out; a null key never is."""
    return reduce(or_, [F.col(c).isNotNull() & below_cutoff([c], seed, cutoff) for c in columns])


def group_split(df: DataFrame, columns: Sequence[str], *, fraction: float = HELD_OUT_FRACTION, seed: int,
                out: str = "subset", keys_from: DataFrame | None = None) -> DataFrame:
    """Adds 1 (validation) to rows touching a held-out key and 0 (train) to the others.

    The keys are those of ``df``, or of ``keys_from`` where a cheaper scan holds the same columns.
    Held-out keys are those up to a hash cutoff, so a row decides from its own keys and one constant:
    the rows are neither joined nor shuffled, however many keys are held out.
    """
    cutoff = held_out_cutoff(df if keys_from is None else keys_from, columns, fraction=fraction, seed=seed)
    held = any_held_out(columns, seed, cutoff)
    return df.withColumn(out, F.when(held, VALIDATION).otherwise(TRAIN).cast("tinyint"))


def flag_members(df: DataFrame, columns: Sequence[str], keys: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    """Adds whether any of ``columns`` is in the given key set.

    The key set is written out once, then broadcast if its counted size allows; a larger one is
    joined with hot keys spread, which are looked for in ``df``, not in what earlier joins made of it.
    """
    members = pinned(keys.select(F.col(key).alias("member")).where(F.col("member").isNotNull()).distinct())
    small = fits_broadcast(members)
    marked, flags = df, []
    for i, column in enumerate(columns):
        flag = fresh(f"_in{i}", df, [out])
        found = members.select(F.col("member").alias(column), F.lit(True).alias(flag))
        marked = (
            marked.join(F.broadcast(found), column, "left") if small
            else spread_join(marked, found, [column], "left", hot=hot_keys(df, [column]))
        )
        flags.append(F.coalesce(F.col(flag), F.lit(False)))
    return marked.select(*[F.col(c) for c in df.columns if c.lower() != out.lower()], reduce(or_, flags).alias(out))


def keep_members(df: DataFrame, columns: Sequence[str], keys: DataFrame, key: str) -> DataFrame:
    """Rows with any of ``columns`` in the key set."""
    flag = fresh("_member", df)
    return flag_members(df, columns, keys, key, flag).where(F.col(flag)).drop(flag)


def drop_members(df: DataFrame, columns: Sequence[str], keys: DataFrame, key: str) -> DataFrame:
    """Rows with none of ``columns`` in the key set."""
    flag = fresh("_member", df)
    return flag_members(df, columns, keys, key, flag).where(~F.col(flag)).drop(flag)


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both."""
    return left.select(key).intersect(right.select(key))


def overlap_size(left: Column, right: Column) -> Column:
    """Number of distinct elements two arrays share."""
    return F.size(F.array_intersect(left, right))


def leakage(df: DataFrame, columns: Sequence[str], held_out: DataFrame, key: str = "block",
            subset: str = "subset") -> DataFrame:
    """One row: rows per subset and training rows that touch a held-out key (must be 0)."""
    flag = fresh("_member", df)
    flagged = flag_members(df, columns, held_out, key, flag)
    train = F.col(subset) == TRAIN
    return flagged.agg(
        F.count_if(train).alias("n_train"),
        F.count_if(F.col(subset) == VALIDATION).alias("n_validation"),
        F.count_if(train & F.col(flag)).alias("n_leaked"),
    )
