"""Seeded pseudo-random values as a function of a row key.

Every random choice is a hash of (key, seed) rather than a generator state, so a recomputed task
draws the same values and the same SQL gives them in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_string(*keys: Column | str) -> Column:
    """The key columns as one string joined by ``|``; a null part is written as ``~``."""
    parts = []
    for key in keys:
        column = F.col(key) if isinstance(key, str) else key
        parts += [F.lit("|"), F.coalesce(column.cast("string"), F.lit("~"))]
    return parts[1] if len(keys) == 1 else F.concat(*parts[1:])


def seeded_hash(*keys: Column | str, seed: int | Column) -> Column:
    """32 hexadecimal digits, uniform over the keys."""
    tail = F.concat(F.lit("|"), seed.cast("string")) if isinstance(seed, Column) else F.lit(f"|{seed}")
    return F.md5(F.concat(key_string(*keys), tail))


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def hash_uint32(text: Column, word: int = 0) -> Column:
    """Word ``word`` (0-3) of the text's digest as an integer in [0, 2^32)."""
    return hex_to_long(F.substring(F.md5(text), 8 * word + 1, 8))


def uniform(*keys: Column | str, seed: int | Column, word: int = 0) -> Column:
    """A double in [0, 1); ``word`` selects one of four independent draws from one digest."""
    return digest_uniform(seeded_hash(*keys, seed=seed), word)


def digest_uniform(digest: Column, word: int = 0) -> Column:
    return hex_to_long(F.substring(digest, 8 * word + 1, 8)) / F.lit(4294967296.0)
