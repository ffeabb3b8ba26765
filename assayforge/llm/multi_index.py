"""Hard negatives by an inverted multi-index: exact best scores inside score windows.

Vectors are cut into two halves, each with a codebook; a cell is a pair of codes. A query's score with any
row of a cell is at most the sum of two half bounds, each the product with the half's centroid plus the
query half's length times the radius of the code, which covers every row. Cells are visited in the order of
that sum until no unvisited cell can change the first k rows of any of the query's windows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.llm.batches import map_rows, written

SAMPLE = 8192  # rows, at most about, on which the codebooks of a vector length are fitted
FITS = 12
MOST_CODES = 64  # a half; with the cells, 64 * 64, it bounds what driver and broadcast hold
ROWS_PER_CELL = 256
ROWS_PER_SHARD = 8192
FIRST_ROWS = 2048  # rows of the cells visited first, whose scores set the limits of the second round
FAR = 2**62


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def integer_vector(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def fitted(points: np.ndarray, codes: int) -> np.ndarray:
    """Centroids of ``points`` by Lloyd's rounds from evenly spaced ones, rounded to whole numbers; fewer where equal."""
    if not points.size:
        return np.zeros((1, points.shape[1]), np.int64)
    centroids = np.unique(points[np.linspace(0, len(points) - 1, codes).astype(int)], axis=0).astype(float)
    for _ in range(FITS):
        code, _ = nearest(points, centroids)
        n = np.bincount(code, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, code, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(np.rint(centroids).astype(np.int64), axis=0)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid next to each point, and the distance, rounded up."""
    x, c = points.astype(float), centroids.astype(float)
    code = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, np.int64)
    return code, np.ceil(np.sqrt(((x - c[code]) ** 2).sum(1)) * (1 + 1e-9)).astype(np.int64)


@dataclass
class MultiIndex:
    """Codebooks of both halves, the radius of each code, and the rows and shards of each cell."""

    split: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    rows: np.ndarray | None = None  # rows of each cell
    first: np.ndarray | None = None  # first shard of each cell
    parts: np.ndarray | None = None  # shards of a cell: one, or several of a cell that is larger than a shard

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[..., :self.split], vectors[..., self.split:]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and its distances from both centroids."""
        (a, near), (b, close) = (nearest(x, book) for x, book in zip(self.halves(vectors), self.books, strict=True))
        return a * len(self.books[1]) + b, [near, close]

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every code of each half the most that it can add to the query's score, as whole numbers."""
        out = []
        for half, book, radius in zip(self.halves(query), self.books, self.radii, strict=True):
            length = math.sqrt(float((half.astype(float) ** 2).sum())) * (1 + 1e-9)
            out.append(book @ half + np.ceil(length * radius).astype(np.int64))
        return tuple(out)

    def fill(self, cells: list) -> None:
        """Takes the rows and radii of (cell, n, near, close), and deals cells to shards in the order of their numbers."""
        shape = [len(b) for b in self.books]
        self.radii = tuple(np.zeros(n, np.int64) for n in shape)
        self.rows = np.zeros(shape[0] * shape[1], np.int64)
        for cell, n, near, close in cells:
            self.rows[cell] = n
            for half, code, radius in zip(self.radii, divmod(cell, shape[1]), (near, close), strict=True):
                half[code] = max(half[code], radius)
        self.parts = np.maximum(1, -(-self.rows // ROWS_PER_SHARD))
        self.first = np.zeros(len(self.rows), np.int64)
        shard, held = 0, 0
        for cell, n in enumerate(self.rows.tolist()):
            if held and held + n > ROWS_PER_SHARD:
                shard, held = shard + 1, 0
            self.first[cell] = shard
            held += n
            if self.parts[cell] > 1:
                shard, held = shard + int(self.parts[cell]), 0


def visited(first: np.ndarray, second: np.ndarray, least: int = -FAR) -> Iterator[tuple[int, int, int]]:
    """(bound, code, code) of the cells in falling order of first[code] + second[code], down to ``least``.

    The multi-sequence algorithm: both halves are sorted, and a heap holds the border of the visited corner;
    a cell enters it once its upper neighbour in one direction, and that of the other direction, were taken.
    """
    rows, columns = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    ahead, behind = first[rows].tolist(), second[columns].tolist()
    heap = [(-(ahead[0] + behind[0]), 0, 0)] if rows and columns else []
    reached = [0] * len(rows)  # how many cells of each row were taken
    while heap:
        bound, i, j = heapq.heappop(heap)
        if -bound < least:
            return
        yield -bound, rows[i], columns[j]
        reached[i] = j + 1
        if j + 1 < len(columns) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(ahead[i] + behind[j + 1]), i, j + 1))
        if i + 1 < len(rows) and reached[i + 1] == j:
            heapq.heappush(heap, (-(ahead[i + 1] + behind[j]), i + 1, j))


def build(stored: DataFrame) -> tuple[dict[int, MultiIndex], DataFrame]:
    """An index for each vector length of ``stored`` (row, vec_id, label, dim, v), and its rows with cell and shard.

    Codebooks are fitted on about ``SAMPLE`` rows chosen by hash; every row is indexed, and radii cover all.
    The driver gets the sample, and one line a cell.
    """
    spark = stored.sparkSession
    sizes = {r["dim"]: r["count"] for r in stored.groupBy("dim").count().collect()}  # one line a vector length
    if not sizes:
        return {}, stored.select("*", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("shard"))
    shares = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, int(2**31 * min(1.0, SAMPLE / n)))])
    chosen = stored.where(F.pmod(F.xxhash64("row"), F.lit(2**31)) <= F.element_at(shares, F.col("dim")))
    sample = chosen.select("dim", "row", "v").limit(2 * SAMPLE * len(sizes)).toArrow().to_pylist()
    indexes = {}
    for dim, n in sizes.items():
        own = sorted((r["row"], r["v"]) for r in sample if r["dim"] == dim)
        points = np.array([v for _, v in own], np.int64).reshape(len(own), dim)
        codes = max(1, min(MOST_CODES, math.isqrt(n // ROWS_PER_CELL)))
        books = [fitted(x, codes) for x in (points[:, :dim // 2], points[:, dim // 2:])]
        indexes[dim] = MultiIndex(dim // 2, tuple(books))
    shared = spark.sparkContext.broadcast(indexes)

    def run(batches) -> Iterator[dict]:
        for batch in batches:
            dims, rows = batch.column(3).to_numpy(), _vectors(batch.column(4))
            cell, near, close = (np.zeros(len(dims), np.int64) for _ in range(3))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                found, (a, b) = shared.value[dim].codes(np.array([rows[i] for i in own]).reshape(len(own), dim))
                cell[own], near[own], close[own] = found, a, b
            yield {name: batch.column(i) for i, name in enumerate(("row", "vec_id", "label", "dim", "v"))} | {
                "cell": pa.array(cell, pa.int32()), "near": pa.array(near), "close": pa.array(close)}

    coded = written(map_rows(stored.select("row", "vec_id", "label", "dim", "v"), run,
                             "row long, vec_id long, label long, dim int, v array<long>, cell int, near long, close long"), "cells")
    lines = coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("near"), F.max("close")).collect()
    for dim, index in indexes.items():
        index.fill([tuple(line)[1:] for line in lines if line["dim"] == dim])
    places = spark.createDataFrame([(line["dim"], line["cell"], int(indexes[line["dim"]].first[line["cell"]]),
                                     int(indexes[line["dim"]].parts[line["cell"]])) for line in lines],
                                   "dim int, cell int, first long, parts long")
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return indexes, coded.join(F.broadcast(places), ["dim", "cell"]).select(
        "row", "vec_id", "label", "dim", "v", "cell", shard.alias("shard"))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _routed(requests: DataFrame, shared, again: bool) -> DataFrame:
    """A line for each shard that a request has to go to.

    At first the cells on top, until they have ``FIRST_ROWS`` rows; ``upto`` becomes the last one's bound.
    ``again``: the cells below ``upto`` that reach the lowest window limit.
    """
    def run(batches) -> Iterator[dict]:
        for batch in batches:
            lines = {name: [] for name in ("dim", "shard", "row", "vec_id", "label", "v", "low", "high", "same", "upto")}
            for request, query in zip(batch.to_pylist(), _vectors(batch.column(batch.schema.get_field_index("v"))), strict=True):
                index = shared.value[request["dim"]]
                first, second = index.bounds(query)
                bounds = (first[:, None] + second[None, :]).ravel()
                if again:
                    wanted, upto = (bounds < request["upto"]) & (bounds >= min(request["low"])), request["upto"]
                else:
                    seen, upto = 0, -FAR
                    for bound, i, j in visited(first, second):
                        seen += int(index.rows[i * len(second) + j])
                        if seen >= FIRST_ROWS:
                            upto = bound
                            break
                    wanted = bounds >= upto
                cells = np.flatnonzero(wanted & (index.rows > 0))
                shards = {int(s) for cell in cells for s in range(index.first[cell], index.first[cell] + index.parts[cell])}
                for shard in sorted(shards):
                    for name, column in lines.items():
                        column.append({"shard": shard, "upto": upto}.get(name, request.get(name)))
            yield lines

    ddl = ("dim int, shard long, row long, vec_id long, label long, v array<long>, low array<long>, high array<long>, "
           "same boolean, upto long")
    return map_rows(requests, run, ddl)


class Shard:
    """Rows of one shard, cell by cell."""

    def __init__(self, index: MultiIndex, row: np.ndarray, ids: np.ndarray, label: np.ndarray, cell: np.ndarray, vectors: np.ndarray):
        self.index, self.row, self.ids, self.label = index, row, ids, label
        cells, start = np.unique(cell, return_index=True)
        self.place = {c: (a, b) for c, a, b in zip(cells.tolist(), start.tolist(), [*start[1:].tolist(), len(cell)], strict=True)}
        codes = [divmod(c, len(index.books[1])) for c in self.place]
        self.first, self.second = (np.array(sorted(set(x)), np.int64) for x in zip(*codes, strict=True))
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors, self.exact = vectors, vectors.astype(float)

    def scores(self, query: np.ndarray, a: int, b: int) -> np.ndarray:
        """Inner products; by doubles where every partial sum is a whole number below 2^53."""
        if self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53:
            return (self.exact[a:b] @ query.astype(float)).astype(np.int64)
        return self.vectors[a:b] @ query

    def best(self, row: int, label: int, query: np.ndarray, low: list[int], high: list[int], same: bool, upto: int,
             again: bool, k: int) -> list[list[tuple[int, int, int]]]:
        """The first k (-score, vec_id, row) of every window among the cells of this round.

        ``low`` rises to a window's k-th score; no cell whose bound is below all of them is read.
        """
        low = list(low)
        found: list[list[tuple[int, int, int]]] = [[] for _ in low]
        first, second = self.index.bounds(query)
        for bound, i, j in visited(first[self.first], second[self.second]):
            if bound < (min(low) if again else max(upto, min(low))):
                break
            place = self.place.get(int(self.first[i]) * len(second) + int(self.second[j]))
            if place is None or again and bound >= upto:
                continue
            a, b = place
            score = self.scores(query, a, b)
            fits = np.flatnonzero((score >= min(low)) & ((self.label[a:b] == label) == same) & (self.row[a:b] != row))
            score, ids, rows = score[fits], self.ids[a:b][fits], self.row[a:b][fits]
            for w, top in enumerate(high):
                inside = np.flatnonzero((score >= low[w]) & (score <= top))
                inside = inside[np.lexsort((rows[inside], ids[inside], -score[inside]))[:k]]
                if len(inside):
                    found[w] = sorted([*found[w], *zip((-score[inside]).tolist(), ids[inside].tolist(), rows[inside].tolist(),
                                                       strict=True)])[:k]
                    if len(found[w]) == k:
                        low[w] = max(low[w], -found[w][-1][0])
        return found


def _answered(rows: DataFrame, lines: DataFrame, shared, again: bool, k: int) -> DataFrame:
    """(query, part, vec_id, row, score): the first k of every window in each shard that a request goes to."""
    empty = F.array().cast("array<long>")
    stored = rows.select("dim", "shard", F.lit(0).alias("asks"), "row", "vec_id", "label", "cell", "v", empty.alias("low"),
                         empty.alias("high"), F.lit(False).alias("same"), F.lit(0).cast("long").alias("upto"))
    both = stored.unionByName(lines.withColumn("asks", F.lit(1)).withColumn("cell", F.lit(0)))

    def run(batches) -> Iterator[dict]:
        at, shard, held = None, None, []
        for batch in batches:
            dim, where, asks, row, ids, label, cell = (batch.column(i).to_numpy() for i in range(7))
            vectors, low, high = (_vectors(batch.column(i)) for i in (7, 8, 9))
            same, upto = batch.column(10).to_pylist(), batch.column(11).to_pylist()
            out = {name: [] for name in ("query", "part", "vec_id", "row", "score")}
            for n in range(len(dim)):
                if (dim[n], where[n]) != at:
                    at, shard, held = (dim[n], where[n]), None, []
                if not asks[n]:
                    held.append((row[n], ids[n], label[n], cell[n], vectors[n]))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    columns = [np.array(x) for x in zip(*held, strict=True)]
                    shard, held = Shard(shared.value[at[0]], *columns[:4], columns[4].reshape(len(held), at[0])), []
                found = shard.best(row[n], label[n], vectors[n], low[n].tolist(), high[n].tolist(), same[n], upto[n], again, k)
                for w, best in enumerate(found):
                    for score, vec_id, place in best:
                        for column, value in zip(out.values(), (row[n], w, vec_id, place, -score), strict=True):
                            column.append(value)
            yield out

    dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "cell", "row")
    return map_rows(dealt, run, "query long, part int, vec_id long, row long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "part").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, requests: DataFrame, indexes: dict[int, MultiIndex], k: int) -> DataFrame:
    """(query, part, rank, vec_id, row, score): the first k rows of every window of every request, exactly.

    ``requests`` are rows with ``low`` and ``high``, the limits of each window (``part`` numbers them), and
    ``same``, whether labels must be equal or differ; ``query`` is the request's row, which isn't its own
    answer. Scores fall with rank, ties go by vec_id. A request is sent to the shards of its best cells
    first; the scores found raise its limits, and then to those of the other cells that reach them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(indexes)
    lines = written(_routed(requests.withColumn("upto", F.lit(0).cast("long")), shared, False), "first-lines")
    near = written(_first(_answered(rows, lines, shared, False, k), k), "first-found")
    reached = lines.groupBy("row").agg(F.first("upto").alias("upto"))  # equal in all lines of a request
    limits = near.groupBy("query", "part").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
    limits = limits.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("part", "worst"))).alias("worst"))
    raised = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("worst", w), x)))
    again = requests.join(reached, "row").join(limits, F.col("row") == F.col("query"), "left").select(
        *[c for c in requests.columns if c != "low"], raised.alias("low"), "upto")
    far = _answered(rows, _routed(again, shared, True), shared, True, k)
    return _first(near.drop("rank").unionByName(far), k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, *, positives: int = 5, k: int = 5, least: int = 80,
                   most: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); scores are inner products of these whole numbers with the anchor,
    higher ones first, ties by smaller vec_id. Each row for which ``anchors`` holds has as positives its first
    ``positives`` other rows of the same ``label``, and for each of them its negatives are the first ``k`` rows of
    another label with least * positive_score <= 100 * negative_score <= most * positive_score. All that there
    are, if fewer.

    Rows take no part if their vec_id, label or vector is null, or a component is null or not finite. Vectors
    of different lengths don't meet. Repeated rows are rows of their own, as positives and negatives too, but
    an anchor that repeats (same vec_id, label and vector) is answered once. No rows give no rows.
    """
    clean = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & label.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.size("embedding").alias("dim"),
        integer_vector(F.col("embedding"), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    stored = written(clean, "vectors")
    indexes, rows = build(stored)
    asked = stored.where("asks").groupBy("vec_id", "label", "dim", "v").agg(F.min("row").alias("row"))
    whole = F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high"), F.lit(True).alias("same")
    found = search(rows, asked.select("*", *whole), indexes, positives)
    limits = _floored(-least * F.col("score")) * -1, _floored(most * F.col("score"))
    known = written(found.select("query", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                                 limits[0].alias("low"), limits[1].alias("high")).where("low <= high"), "positives")
    windows = known.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    requests = written(asked.join(windows, F.col("row") == F.col("query")).select(
        *asked.columns, F.col("w.rank").alias("places"), F.col("w.low").alias("low"), F.col("w.high").alias("high"),
        F.lit(False).alias("same")), "windows")
    hard = search(rows, requests.drop("places"), indexes, k)
    named = requests.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"), F.posexplode("places").alias("part", "place"))
    pairs = named.join(known.select("query", F.col("rank").alias("place"), "positive_id", "positive_score"), ["query", "place"])
    return hard.join(pairs, ["query", "part"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _floored(hundredths: Column) -> Column:
    """The largest whole number that isn't above a hundredth of it."""
    return ((hundredths - F.pmod(hundredths, F.lit(100))) / 100).cast("long")
