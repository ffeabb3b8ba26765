"""Equal scores merged and put in order over a whole DataFrame, as sorted runs that are cut into ranges.

A run is what a task has of a group: its different scores in falling order, with how many positives and rows each has.
Runs travel as compressed Arrow bytes instead of a row a score, and only once, to the range that merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from assayforge.functions.names import fresh
from assayforge.operators.ranking import running_totals
from assayforge.session import pinned

RUN_ROWS = 1 << 18  # rows that a task sorts at once
RANGE_ROWS = 1 << 19  # about as many scores of runs meet in a range, which one task merges
RUNS_CUT = 4  # runs of a task that are cut together, so that there are fewer pieces
SAMPLE_EVERY = 1 << 12
LAST = np.iinfo(np.int64).max  # null scores come last


def _falling(scores: pa.Array) -> np.ndarray:
    """Integers that rise where scores fall, equal for equal scores: not-a-number, infinity to minus infinity, null."""
    value = pc.fill_null(scores, 0.0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
    bits = np.where(np.isnan(value), np.nan, value).view(np.int64)
    rising = np.where(bits < 0, bits ^ LAST, bits)
    return np.where(scores.is_null().to_numpy(zero_copy_only=False), LAST, ~rising)


def _merged(keys: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(pos[order], first), np.add.reduceat(n[order], first)


def _pack(*columns: np.ndarray) -> bytes:
    """The columns by places of their bytes: first bytes, second bytes and so on, most of which are alike in sorted scores and counts."""
    raw = np.concatenate(columns).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def _unpack(steps: pa.Scalar) -> list[np.ndarray]:
    packed = steps.as_buffer()
    size = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], size, codec="lz4"), np.uint8)
    return list(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(3, -1))


def _groups(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """The rows of each different value of the first ``width`` columns, and one row that has it."""
    code = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:width]:
        own = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(code)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(int(order[a]), 1), None if b - a == len(code) else order[a:b]


def _schema(df: DataFrame, by: Sequence[str], more: dict) -> StructType:
    return StructType([*[df.schema[c] for c in by], *[StructField(c, kind) for c, kind in more.items()]])


def _runs(df: DataFrame, by: Sequence[str], y: str, p: str, size: str, steps: str) -> DataFrame:
    """(by..., known, size, sample, steps): the sorted runs, written out. ``known`` counts labels that are not null."""
    width = len(by)
    rows = df.dropna(subset=[*by]).select(*by, F.col(p).cast("double").alias(f"{steps}p"), F.col(y).cast("long").alias(f"{steps}y"))
    schema = _schema(df, by, {f"{size}_known": LongType(), size: LongType(), steps: BinaryType()})
    schema.add(f"{steps}_sample", ArrayType(LongType()))
    arrow = to_arrow_schema(schema)

    def emit(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        key, label = _falling(whole.column(width)), whole.column(width + 1)
        known = label.is_valid().to_numpy(zero_copy_only=False)
        pos = pc.fill_null(label, 0).to_numpy()
        for one, at in _groups(whole, width):
            at = slice(None) if at is None else at
            keys, own, n = _merged(key[at], pos[at], np.ones(len(key[at]), np.int64))
            yield pa.RecordBatch.from_arrays(
                [*one.columns[:width], pa.array([int(known[at].sum())]), pa.array([len(keys)]),
                 pa.array([_pack(keys, own, n)], pa.binary()), pa.array([keys[SAMPLE_EVERY // 2 :: SAMPLE_EVERY]], pa.list_(pa.int64()))],
                schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                held += batch.num_rows
            if held >= RUN_ROWS:
                yield from emit(kept)
                kept, held = [], 0
                pa.default_memory_pool().release_unused()
        if kept:
            yield from emit(kept)

    return pinned(rows.mapInArrow(run, schema))


def mean_precision(df: DataFrame, *, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """(by..., n, n_positive, average_precision): the mean of the precision at each positive, from the highest score down.

    ``by`` are one or more columns of plain values; rows with a null in one have no group. Scores are compared as doubles,
    labels are whole numbers. Ranges follow samples of the runs, so that each holds about ``RANGE_ROWS`` scores of all
    groups; a score that many rows have is one entry of a run. The driver gets the cuts between ranges.
    """
    size, steps, part, pos, n, area = (fresh(name, df) for name in ("_size", "_steps", "_range", "_pos", "_rows", "_area"))
    known, sample = f"{size}_known", f"{steps}_sample"
    runs = _runs(df, by, y, p, size, steps)
    ranges, cuts = math.ceil((runs.agg(F.sum(size)).first()[0] or 0) / RANGE_ROWS), np.zeros(0, np.int64)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = runs.select(F.explode(sample).alias("key")).agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))
    width = len(by)

    def cut(whole: bool):
        def pieces(rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
            """What some runs of a group have in each range."""
            runs = [_unpack(rows.column(width)[i]) for i in at.tolist()]
            ends = [[0, *np.searchsorted(columns[0], cuts).tolist(), len(columns[0])] for columns in runs]
            has = [r for r in range(len(cuts) + 1) if any(e[r] < e[r + 1] for e in ends)]
            if whole:
                held = ([np.concatenate([c[e[r]:e[r + 1]] for c, e in zip(cs, ends, strict=True)]) for cs in zip(*runs, strict=True)] for r in has)
                more = [pa.array([_pack(*columns) for columns in held], pa.binary())]
            else:
                sums = [[int(sum(columns[i][e[r]:e[r + 1]].sum() for columns, e in zip(runs, ends, strict=True))) for r in has] for i in (1, 2)]
                more = [pa.array(x, pa.int64()) for x in sums]
            own = rows.slice(int(at[0]), 1).take(pa.array(np.zeros(len(has), np.int64)))
            return pa.RecordBatch.from_arrays([*own.columns[:width], pa.array(has, pa.int32()), *more], names=[*by, *names[whole]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, at in _groups(batch, width):
                    at = np.arange(batch.num_rows) if at is None else at
                    for a in range(0, len(at), RUNS_CUT):
                        yield pieces(batch, at[a:a + RUNS_CUT])
            pa.default_memory_pool().release_unused()

        names = {True: [part, steps], False: [part, pos, n]}
        kinds = {part: IntegerType(), **({steps: BinaryType()} if whole else {pos: LongType(), n: LongType()})}
        return runs.select(*by, steps).mapInArrow(run, _schema(df, by, kinds))

    totals = cut(False).groupBy(*by, part).agg(F.sum(pos).alias(pos), F.sum(n).alias(n))
    offsets = running_totals(totals, part, [pos, n], by)
    schema = _schema(df, by, {pos: LongType(), n: LongType(), area: DoubleType()})
    arrow = to_arrow_schema(schema)

    def merge(table: pa.Table) -> pa.Table:
        found = [_unpack(s) for s in table.column(steps)]
        _, own, rows = _merged(*[np.concatenate(c) for c in zip(*found, strict=True)])
        before, above = (table.column(c)[0].as_py() for c in (pos, n))
        total = float((own * ((before + np.cumsum(own)) / (above + np.cumsum(rows)))).sum())
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in by], pa.array([int(own.sum())]),
                                     pa.array([int(rows.sum())]), pa.array([total])], schema=arrow)

    merged = cut(True).join(offsets, [*by, part]).groupBy(*by, part).applyInArrow(merge, schema)
    labelled = runs.select(*by, *[F.lit(0).cast(f.dataType).alias(f.name) for f in schema[width:]], known)
    both = merged.withColumn(known, F.lit(0).cast("long")).unionByName(labelled)
    return both.groupBy(*by).agg(
        F.sum(n).alias("n"), F.when(F.sum(known) > 0, F.sum(pos)).alias("n_positive"),
        F.coalesce(F.try_divide(F.sum(area), F.sum(pos)), F.lit(0.0)).alias("average_precision"))
