"""Arrow wrappers for the user's own Python functions; everything else is column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON_ERROR = ("null", "keep", "fail")
ITEMS_PER_SLICE = 1 << 19


def safe_map(fn: Callable[[str], str], on_error: str = "null") -> Callable[[Column | str], Column]:
    """A string function applied per value, in Arrow batches.

    Nulls pass through. A value the function rejects becomes null (``null``), stays as it is
    (``keep``) or fails the job (``fail``).
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error: {on_error}")

    def apply(value):
        if not isinstance(value, str):
            return None
        try:
            return fn(value)
        except Exception:
            if on_error == "fail":
                raise
            return value if on_error == "keep" else None

    @F.pandas_udf(T.StringType())
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(apply)

    return mapped


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A function from DataFrame batch to DataFrame batch with a declared output schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def batch_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], *, batch_size: int = 1024,
                 input_length: int | None = None) -> Callable[[Column | str], Column]:
    """Scores of an arbitrary model as an array column.

    ``load`` runs once per Python worker and returns the predict function, which gets a batch of
    inputs and returns one row of outputs per input. ``input_length`` is the fixed length of an
    array input.
    """
    shapes = None if input_length is None else [[input_length]]
    return predict_batch_udf(
        load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes
    )


def list_slices(rows: pa.ListArray, most: int = ITEMS_PER_SLICE) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with about ``most`` items together, one row at least.

    An Arrow batch is bounded by rows, so that one of long rows is worked on in such parts.
    """
    offsets = rows.offsets.to_numpy().astype(np.int64)
    part = (offsets[1:] - offsets[0]) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if start < end:
            yield start, end


def joined_arrays(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """The parts in a row; no parts are an empty array."""
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
