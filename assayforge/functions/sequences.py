"""String and array expressions for token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.schemas import PAD_ID

# The published SMILES tokenisation pattern (Schwaller et al. 2019), and a plain
# pattern for running text in which every non-blank character belongs to some token.
SMILES_PATTERN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
)
TEXT_PATTERN = r"([A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r])"

LINKER = "[Dy]"
HYDROGEN = "[H]"


def replace_linker(text: Column, linker: str = LINKER, replacement: str = HYDROGEN) -> Column:
    """Every occurrence of the linker text replaced (literal, not a pattern)."""
    return F.replace(text, F.lit(linker), F.lit(replacement))


def replace_pattern(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def tokenize(text: Column, pattern: str = SMILES_PATTERN) -> Column:
    """All matches of ``pattern`` in order; the pattern needs one capturing group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def elements(df: DataFrame, array: str, *keep: str, position: str = "position", value: str = "value") -> DataFrame:
    """One row (keep..., position, value) per array element.

    The outer form and a filter on the position give the same rows as a plain explode, for which
    Spark adds a filter on the array and so works out a computed array three times.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.where(F.col(position).isNotNull())


def pad(ids: Column, length: int, on_overflow: str = "error", fill: int = PAD_ID) -> Column:
    """``ids`` filled up to ``length``.

    A longer sequence raises (``error``), is cut (``truncate``), becomes null (``drop``) or stays
    whole (``keep``).
    """
    size = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(fill).cast("int"), F.greatest(F.lit(length) - size, F.lit(0))))
    if on_overflow == "keep":
        return padded
    if on_overflow == "truncate":
        return F.slice(padded, 1, length)
    if on_overflow == "drop":
        return F.when(size <= length, padded)
    if on_overflow == "error":
        message = F.format_string(f"sequence of %d tokens is longer than {length}", size)
        return F.when(size <= length, padded).otherwise(F.raise_error(message).cast("array<int>"))
    raise ValueError(f"on_overflow: {on_overflow}")


def target_field(target: Column, name: str) -> Column:
    """One field of an array of structs, e.g. the ``label`` of every (label, original) target."""
    return F.transform(target, lambda t: t.getField(name))


def bits_to_dense(bits: Column, n_bits: int) -> Column:
    """0/1 array of length ``n_bits`` from the positions of the set bits."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("tinyint"), n)

    def dense(held: Column) -> Column:
        """Each bit brings the zeros since the bit before it, and its own one."""
        runs = F.transform(held, lambda bit, i: F.concat(
            zeros(bit - F.when(i > 0, F.get(held, i - 1)).otherwise(-1) - 1), F.array(F.lit(1).cast("tinyint"))))
        last = F.when(F.size(held) > 0, F.get(held, F.size(held) - 1)).otherwise(-1)
        return F.concat(F.flatten(runs), zeros(F.lit(n_bits - 1) - last))

    held = F.array_sort(F.array_distinct(F.filter(bits, lambda b: b.between(0, n_bits - 1))))
    return F.get(F.transform(F.array(held), dense), 0)  # bound to a variable, the sorted bits are worked out once
