"""Pivots and metrics that accumulate over arriving files.

What is kept of the rows seen so far merges with what later rows bring in any order and grouping, so the
division of the input into files and micro-batches does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from assayforge.functions.names import fresh
from assayforge.streaming.incremental import append_once


def _rank(value):
    """Sorts as Spark does: not-a-number after all other numbers."""
    return (True, 0) if isinstance(value, float) and math.isnan(value) else (False, value)


def pivot_updates(df: DataFrame, *, keys: Sequence[str], category: str, value: str, categories: Sequence[str],
                  order_by: str | None = None, fill: int | None = None) -> DataFrame:
    """The wide row of every key that a micro-batch changes, as ``pivot_labels`` gives it for all rows so far.

    State of a key: for every category the smallest order seen with its value (of equal orders the smallest
    value), and the smallest value without an order. Rows with a null key or value leave no trace, but a key
    all of whose values are null is there with gaps. Streamed in update mode.
    """
    kind = df.schema[value].dataType
    rank = df.schema[order_by].dataType if order_by is not None else T.IntegerType()
    place = F.col(order_by) if order_by is not None else F.lit(None).cast("int")
    number = {name: i for i, name in enumerate(categories)}
    state_schema = T.StructType([T.StructField("places", T.ArrayType(rank)), T.StructField("placed", T.ArrayType(kind)),
                                 T.StructField("unplaced", T.ArrayType(kind))])
    known = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    # Nulls are told by flags, since Arrow turns null numbers into other ones.
    filled = F.coalesce(place, F.lit(0).cast(rank)) if isinstance(rank, T.NumericType) else place
    seen = known.select(
        *keys, F.coalesce(F.create_map(*[F.lit(x) for item in number.items() for x in item])[F.col(category)], F.lit(-1)).alias("_slot"),
        filled.alias("_place"), place.isNotNull().alias("_has_place"), F.col(value).alias("_value"),
        F.col(value).isNotNull().alias("_has_value"))
    floating = isinstance(kind, (T.FloatType, T.DoubleType))  # leave as text, since Arrow takes not-a-number for null
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(name, T.StringType() if floating else kind) for name in categories]])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size = len(number)
        places, placed, unplaced = map(list, state.get) if state.exists else ([None] * size for _ in range(3))
        for frame in frames:
            for slot, at, has_place, v, has_value in zip(*(frame[c].tolist() for c in (
                    "_slot", "_place", "_has_place", "_value", "_has_value")), strict=True):
                if slot < 0 or not has_value:
                    continue
                if not has_place:
                    if unplaced[slot] is None or _rank(v) < _rank(unplaced[slot]):
                        unplaced[slot] = v
                elif placed[slot] is None or (_rank(at), _rank(v)) < (_rank(places[slot]), _rank(placed[slot])):
                    places[slot], placed[slot] = at, v
        state.update((places, placed, unplaced))
        row = [p if p is not None else u if u is not None else fill for p, u in zip(placed, unplaced, strict=True)]
        if floating:
            row = [v if v is None else repr(float(v)) for v in row]
        names = [*keys, *categories]
        yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip(names, [*key, *row], strict=True)})

    wide = seen.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "update", "NoTimeout")
    return wide.select(*keys, *[F.col(name).cast(kind).alias(name) for name in categories])


def pivot_stream(df: DataFrame, output: str, checkpoint: str, **pivot) -> StreamingQuery:
    """Pivots what has arrived; every micro-batch writes the rows that it changed to a folder of its own.

    The state lies with the checkpoint: a later run goes on from it, and a repeated batch replaces its folder.
    """
    return append_once(pivot_updates(df, **pivot), output, checkpoint, mode="update")


def read_pivot(spark: SparkSession, output: str, keys: Sequence[str]) -> DataFrame:
    """One row a key: what the last micro-batch that changed it wrote."""
    rows = spark.read.parquet(output)
    names = [c for c in rows.columns if c not in ("query_id", "batch_id")]
    last = fresh("_last", names)
    newest = F.max_by(F.struct(*[c for c in names if c not in keys]), F.col("batch_id")).alias(last)
    return rows.groupBy(*keys).agg(newest).select(*keys, f"{last}.*")
