"""Row-local Arrow work over documents, and names that can't clash with the caller's columns."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assayforge.session import new_folder

BYTES_PER_SLICE = 4 * 2**20


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """``make()`` once in each Python worker process, for all of its tasks.

    Functions of this package travel with each task, and so do their globals; what shall outlive a
    task is kept under a module name of its own.
    """
    kept = vars(sys.modules.setdefault("_assayforge_worker", ModuleType("_assayforge_worker")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """What was worked out for strings, of bounded size: two generations, the older one is dropped as a whole."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        """The values of ``keys``, None for unknown ones; what only the older generation has becomes young again."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        found = list(map(self.get, keys))
        if self.older:
            for i, value in enumerate(found):
                if value is None:
                    value = self.older.get(keys[i])
                    if value is not None:
                        found[i] = self[keys[i]] = value
        return found


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, more...) of ``docs``: other columns are dropped, a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def document_hash(text: Column) -> Column:
    """64 bits of a document's text; with doc_id they tell rows of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


Rows = Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]]


def map_rows(df: DataFrame, *steps: Rows | str) -> DataFrame:
    """``mapInArrow`` with functions that yield columns as a dictionary of lists or arrays.

    ``steps`` are functions, each followed by the schema of what it yields. Several of them run one
    after the other on the same batches, in one Python worker.
    """
    parts = [(fn, to_arrow_schema(StructType.fromDDL(ddl))) for fn, ddl in zip(steps[::2], steps[1::2], strict=True)]

    def batches_of(found: Iterable[dict[str, list]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for columns in found:
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow],
                schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on, and the next stage may need the room

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fn, arrow in parts:
            batches = batches_of(fn(batches), arrow)
        return batches

    return df.mapInArrow(run, steps[-1])


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BYTES_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes in a string or binary column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start < end:
                yield batch.slice(start, end - start)


def gathered(packed: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 32-bit integers of ``packed[i]`` for each i of ``index``, in a row, and how many each has."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return runs_of(np.frombuffer(b"".join(packed), "<u4"), sizes, index)


def runs_of(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run i of ``values``, which holds runs of ``sizes`` in a row, for each i of ``index``, and how long each is."""
    first = np.cumsum(sizes) - sizes
    taken = sizes[index]
    shift = first[index] - (np.cumsum(taken) - taken)
    return values[np.arange(taken.sum()) + np.repeat(shift, taken)], taken


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Row i holds the bytes of ``values[offsets[i]:offsets[i + 1]]``."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
