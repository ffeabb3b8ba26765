"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.llm.batches import map_rows

K = 20
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
CELLS = 64
AT_ONCE = 64


def integer_vector(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, infinite or not-a-number component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


class Approximation:
    """Cells of a block's vectors: each component's range cut into equal cells, one byte a component."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        self.low = vectors.min(0) if len(vectors) else np.zeros(vectors.shape[1], np.int64)
        span = (vectors.max(0) if len(vectors) else self.low) - self.low + 1
        self.width = -(-span // cells)
        self.cell = ((vectors - self.low) // self.width).astype(np.uint8)

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest vector of each one's cells."""
        low = self.low + self.cell * self.width
        return low, low + self.width - 1


def search_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: list[np.ndarray], k: int
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best of the block, ties to smaller ids.

    Bounds of all scores come from the cells. Exact vectors are read in the order of their upper
    bounds until the next bound is below the k-th score. ``own``: places that a query leaves out.
    """
    low, high = (x.astype(np.float64) for x in Approximation(vectors).limits())
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    for start in range(0, len(queries), AT_ONCE):
        rows = slice(start, start + AT_ONCE)
        # Whole numbers below 2^53 are exact in doubles; beyond, a relative slack keeps bounds safe.
        upper = positive[rows] @ high.T + negative[rows] @ low.T
        upper += np.abs(upper) * 1e-12 * (np.abs(upper) >= 2**52)
        for i in range(len(upper)):
            query, bound = queries[start + i], upper[i]
            bound[own[start + i]] = -np.inf
            n = len(bound) - len(own[start + i])
            most = min(len(bound), max(4 * k, 256))
            order = np.argpartition(-bound, most - 1)[:most] if most < len(bound) else np.arange(len(bound))
            order = order[np.argsort(-bound[order], kind="stable")]
            place, score, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            while at < n:
                if at >= len(order):  # the rows not in the short list yet; its own stay where they were read
                    rest = np.ones(len(bound), bool)
                    rest[order] = False
                    rest = np.flatnonzero(rest)
                    order = np.concatenate([order, rest[np.argsort(-bound[rest], kind="stable")]])
                if len(score) >= k and bound[order[at]] < score[k - 1]:
                    break
                take = order[at:min(n, at + AT_ONCE)]
                at += len(take)
                place = np.concatenate([place, take])
                score = np.concatenate([score, vectors[take] @ query])
                best = np.lexsort((ids[place], -score))[:k]
                place, score = place[best], score[best]
            yield place, score


def top_k(vectors: DataFrame, queries: Column, *, k: int = K, scale: int = 64,
          candidates_per_block: int = CANDIDATES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``queries`` holds.

    Components become floor(scale * x); the score is the inner product of these whole numbers. Every
    other row is a candidate, ties go to smaller vec_id, a query with fewer than k candidates gets all.
    Rows whose vector or vec_id is null, or holds null or non-finite components, take no part. Vectors of
    different lengths don't meet. A repeated row (same vec_id, same vector) is a candidate for its twin,
    and the query is answered once; different vectors of one vec_id are queries of their own, each with its
    ranks. No rows give no rows.

    Candidates lie in blocks, each with its own cells; blocks of queries are sent to every block of
    candidates of their length, and a query's best of each block are merged.
    """
    clean = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding"), scale).alias("v"),
        F.size("embedding").alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = {r["dim"]: r["count"] for r in clean.groupBy("dim").count().collect()}  # one row per vector length
    blocks = {dim: -(-n // candidates_per_block) for dim, n in sizes.items()}
    most = max(blocks.values(), default=1)
    count = F.element_at(F.create_map(*[F.lit(x) for item in blocks.items() for x in item]), F.col("dim")) if blocks \
        else F.lit(1)
    spread = F.xxhash64("vec_id")
    stored = clean.select("dim", F.pmod(spread, count).cast("int").alias("block"), F.lit(-1).alias("part"), "vec_id", "v",
                          F.lit(0).cast("long").alias("mark"))
    parts = F.ceil(count * candidates_per_block / (20 * queries_per_block)).cast("int")
    asked = clean.where("asks").dropDuplicates(["vec_id", "v"]).select(
        "dim", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"),
        F.pmod(F.shiftright(spread, 20), F.greatest(parts, F.lit(1))).cast("int").alias("part"), "vec_id", "v",
        F.xxhash64("v").alias("mark"))

    def run(batches) -> Iterator[dict]:
        at = None
        pending: dict[str, list] = {"ids": [], "vectors": [], "marks": []}
        held = None

        def flush():
            nonlocal held
            (_, _, part), ids = at, np.concatenate(pending["ids"])
            block = np.concatenate(pending["vectors"])
            if part < 0:
                held = at[:2], ids, block
                return None
            if held is None or held[0] != at[:2]:
                return None
            _, known, stored = held
            order = np.argsort(known, kind="stable")
            left, right = np.searchsorted(known[order], ids, "left"), np.searchsorted(known[order], ids, "right")
            own = []
            for i in range(len(ids)):
                same = [p for p in order[left[i]:right[i]].tolist() if (stored[p] == block[i]).all()]
                own.append(np.array(same[:1], np.int64))
            found = list(search_block(block, stored, known, own, k))
            sizes = [len(p) for p, _ in found]
            number = np.repeat(np.arange(len(ids)), sizes)
            return {"query_id": pa.array(ids[number]), "mark": pa.array(np.concatenate(pending["marks"])[number]),
                    "vec_id": pa.array(known[np.concatenate([p for p, _ in found])]),
                    "score": pa.array(np.concatenate([s for _, s in found]))}

        for batch in batches:
            dims, places, part = (batch.column(i).to_numpy() for i in range(3))
            ids, lists, marks = batch.column(3).to_numpy(), batch.column(4), batch.column(5).to_numpy()
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(places) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                key = (int(dims[a]), int(places[a]), int(part[a]))
                if at is not None and key != at:
                    out = flush()
                    if out:
                        yield out
                    pending = {"ids": [], "vectors": [], "marks": []}
                at = key
                pending["ids"].append(ids[a:b])
                pending["marks"].append(marks[a:b])
                pending["vectors"].append(flat[ends[a]:ends[b]].reshape(b - a, key[0]))
        if at is not None:
            out = flush()
            if out:
                yield out

    spark = vectors.sparkSession
    width = max(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored.unionByName(asked).repartition(width, "dim", "block").sortWithinPartitions("dim", "block", "part", "vec_id")
    found = map_rows(dealt, run, "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
