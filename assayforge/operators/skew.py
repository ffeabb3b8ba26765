"""Joins and lookups that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.functions.names import fresh

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_PARTITIONS = 3  # a key is hot from so many average partitions on


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bytes(name: str, kind: T.DataType) -> Column:
    """Size of a value: text and binary as they are, nested values by their JSON, others eight bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(F.col(name))))
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes: one row per task is summed up."""
    size = reduce(add, [_bytes(f.name, f.dataType) for f in df.schema.fields], F.lit(0))
    seen = df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], share: float | None = None, out: str = "_salts") -> DataFrame:
    """Non-null keys that hold more than ``share`` of all rows, and in how many parts each is to be cut (``out``).

    By default ``HOT_PARTITIONS`` average partitions are hot, so both the share and the number of
    parts, two per average partition of the key, follow the number of shuffle partitions. There are
    fewer than ``1 / share`` hot keys, and together they have about two parts a partition.
    """
    partitions = _partitions(df)
    share = HOT_PARTITIONS / partitions if share is None else share
    n = fresh("_n", keys)
    counts = df.where(~_any_null(keys)).groupBy(*keys).agg(F.count("*").alias(n))
    total = counts.agg(F.sum(n).alias("total")).scalar()
    hot = counts.where(F.col(n) > F.lit(share) * total)
    return hot.select(*keys, F.ceil(F.lit(2.0 * partitions) * F.col(n) / total).cast("int").alias(out))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                share: float | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of a large ``left`` with a ``right`` that has one row per key.

    Rows of a hot key on the left are dealt, row by row, to as many parts as ``hot_keys`` gives it, and
    only that key's row on the right is repeated for each of them. Rows with a null key match nothing
    and are dealt likewise. ``hot`` gives the hot keys of ``left`` where they are known already, its last
    column the number of parts.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    row, salt, salts = (fresh(name, left, right) for name in ("_row", "_salt", "_salts"))
    hot = hot_keys(left, keys, share, salts) if hot is None else hot.withColumnRenamed(hot.columns[-1], salts)
    parts = F.when(_any_null(keys), F.lit(2 * _partitions(left))).otherwise(F.col(salts))
    dealt = left.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(hot), list(keys), "left").withColumn(
        salt, F.coalesce(F.pmod(F.col(row), parts).cast("int"), F.lit(0))
    )
    copies = F.when(F.col(salts) > 0, F.sequence(F.lit(0), F.col(salts) - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), list(keys), "left").withColumn(salt, F.explode(copies)).drop(salts)
    return dealt.drop(salts, row).join(repeated, [*keys, salt], how).drop(salt)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a keyed table: broadcast while its counted size allows, else ``spread_join``."""
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), list(keys), how)
    return spread_join(left, right, keys, how)
