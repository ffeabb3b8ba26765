"""Names of helper columns that can't clash with the caller's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(name: str, *taken: DataFrame | Iterable[str]) -> str:
    """``name``, with underscores in front until no DataFrame or list of names in ``taken`` has it in any case."""
    used = {c.lower() for names in taken for c in (names.columns if isinstance(names, DataFrame) else names)}
    while name.lower() in used:
        name = f"_{name}"
    return name
