"""Token-id files with a minimal perfect hash index from document key to place.

A shard is one payload file and one index file. The payload is the ids of its documents in ascending
doc_id order, nothing else, little-endian, two bytes each where the vocabulary has at most 65,536 ids
and four otherwise. The index has a header of five 64-bit integers (id width, documents, keys, buckets,
ids), then, little-endian:

* displacements: int32 per bucket,
* per slot: fingerprint uint32, number of the key's first document uint32, where in the payload its ids begin
  and how many they are: two uint64; 24 bytes in a row,
* per document: doc_id int64, has_id uint8, and where its ids end: uint64.

A key's bucket and two hashes give its slot; a wrong fingerprint says that the key is absent. One key is looked up
by four short reads: header, displacement, slot and the document's id, and one of its own ids from the payload.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayforge.llm.batches import binary_array, document_hash, map_rows, slices, texts
from assayforge.llm.tokens import token_ids, word_tokenizer
from assayforge.operators.skew import fits_broadcast
from assayforge.session import new_folder

DOCS_PER_SHARD = 8192
IDS_PER_SHARD = 1 << 23  # a shard ends with the document that reaches it, so it is small however long texts are
SAMPLE_PER_RANGE = 24  # doc_ids on the driver for each limit between ranges
SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("begin", "<u8"), ("size", "<u8")])
MANIFEST = "shard long, path string, n_docs long, n_ids long, first_id long, last_id long, n_null long"
KEYS_PER_BUCKET = 4
_U64 = np.uint64


def key_hashes(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashes of each key, for slot, bucket and fingerprint: splitmix64 with three seeds. A null key has its own."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        x = keys.astype(np.int64).view(_U64) + np.where(known, _U64(seed), _U64(seed // 3))
        x = (x ^ x >> _U64(30)) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> _U64(27)) * _U64(0x94D049BB133111EB)
        out.append(x ^ x >> _U64(31))
    return tuple(out)


def _moved(hashes: np.ndarray, displacement: np.ndarray, keys: int) -> np.ndarray:
    """Slot of each hash under a displacement of 0 or more."""
    x = hashes + displacement.astype(_U64) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ x >> _U64(32)) * _U64(0xD6E8FEB86659FD93)
    return ((x ^ x >> _U64(32)) % _U64(keys)).astype(np.int64)


def _slots(hashes: np.ndarray, displacement: np.ndarray, keys: int) -> np.ndarray:
    d = displacement.astype(np.int64)
    return np.where(d < 0, -d - 1, _moved(hashes, np.maximum(d, 0), keys))


def displacements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per bucket the displacement with which every key gets a slot of its own (hash and displace).

    Large buckets go first; a bucket of one key names its slot, as a negative number.
    """
    keys = len(a)
    buckets = max(1, -(-keys // KEYS_PER_BUCKET))
    out = np.zeros(buckets, np.int32)
    if not keys:
        return out
    bucket = (b % _U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    taken = np.zeros(keys, bool)
    singles = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        own = order[ends[i] - sizes[i]:ends[i]]
        if len(own) < 2:
            singles += [(i, own[0])] if len(own) else []
            continue
        at = 0
        while True:
            tries = np.arange(at, at + 64)
            slots = _moved(a[own], tries[:, None], keys)
            good = ~taken[slots].any(1)
            if good.any():
                ranked = np.sort(slots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                found = int(good.argmax())
                out[i] = at + found
                taken[slots[found]] = True
                break
            at += 64
            if at > 1_000_000:  # keys of one bucket that no displacement parts: a new seed is needed
                raise ValueError("keys collide in all hashes")
    for (i, _), slot in zip(singles, np.flatnonzero(~taken).tolist(), strict=True):
        out[i] = -slot - 1
    return out


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1)
                                    if folder.startswith("file:") else f"file://{folder}")


def _put(system: pafs.FileSystem, path: str, data: list[bytes]) -> None:
    """Written under another name first: a task that runs twice leaves one whole file."""
    part = f"{path}.{np.random.default_rng().integers(2**63):x}.part"
    with system.open_output_stream(part) as file:
        for block in data:
            file.write(block)
    system.move(part, path)


class Shard:
    """A shard read from its files."""

    def __init__(self, system: pafs.FileSystem, path: str):
        with system.open_input_file(f"{path}.idx") as file:
            data = file.read()
        width, docs, keys, buckets, self.n_ids = np.frombuffer(data, "<i8", 5).tolist()
        at = 40
        parts = []
        for kind, n in (("<i4", buckets), (SLOT, keys), ("<i8", docs), ("u1", docs), ("<u8", docs)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.displacement, self.slots, self.doc_id, self.has_id, ends = parts
        self.bounds = np.concatenate([[0], ends]).astype(np.int64)
        self.dtype = np.dtype(f"<u{width}")
        with system.open_input_file(f"{path}.ids") as file:
            self.payload = np.frombuffer(file.read(), self.dtype)

    def find(self, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether its fingerprint is there: constant time a key."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        a, b, c = key_hashes(keys, known)
        slot = _slots(a, self.displacement[(b % _U64(len(self.displacement))).astype(np.int64)], len(self.slots))
        return slot, self.slots["fingerprint"][slot] == (c >> _U64(32)).astype(np.uint32)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, has_id, begin, size) of every document, the place of its ids being what the index has for its key.

        Of rows with one key the index has the first; the others follow it.
        """
        known = self.has_id.astype(bool)
        slot, there = self.find(self.doc_id, known)
        if not there.all():
            raise ValueError(f"the index doesn't find document {self.doc_id[~there][0]}")
        held = self.slots[slot]
        leads = held["first"] == np.arange(len(slot))
        begin = np.where(leads, held["begin"], self.bounds[:-1]).astype(np.int64)
        size = np.where(leads, held["size"], np.diff(self.bounds)).astype(np.int64)
        return self.doc_id, known, begin, size


class KeyedShard:
    """One key at a time from a shard's files, by reads of a few bytes each."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.index, self.payload = system.open_input_file(f"{path}.idx"), system.open_input_file(f"{path}.ids")
        self.width, self.docs, self.keys, self.buckets, _ = self._read(self.index, 0, "<i8", 5).tolist()
        self.n_read = 0

    def _read(self, file: pa.NativeFile, at: int, kind, n: int = 1) -> np.ndarray:
        data = file.read_at(np.dtype(kind).itemsize * n, at)
        self.n_read = getattr(self, "n_read", 0) + len(data)
        return np.frombuffer(data, kind)

    def get(self, key: int | None) -> np.ndarray | None:
        """The ids of the key's first document, None if the shard lacks it."""
        if not self.keys:
            return None
        value, known = np.array([key or 0]), np.array([key is not None])
        a, b, c = key_hashes(value, known)
        moved = self._read(self.index, 40 + 4 * int(b[0] % _U64(self.buckets)), "<i4")
        place = int(_slots(a, moved, self.keys)[0])
        slots = 40 + 4 * self.buckets
        (slot,) = self._read(self.index, slots + SLOT.itemsize * place, SLOT)
        if slot["fingerprint"] != np.uint32(int(c[0]) >> 32):
            return None
        ids = slots + SLOT.itemsize * self.keys
        if self._read(self.index, ids + 8 * int(slot["first"]), "<i8")[0] != (key or 0) \
                or bool(self._read(self.index, ids + 8 * self.docs + int(slot["first"]), "u1")[0]) != (key is not None):
            return None
        return self._read(self.payload, self.width * int(slot["begin"]), f"<u{self.width}", int(slot["size"]))

    def close(self) -> None:
        self.index.close()
        self.payload.close()


def _write_shard(system, path: str, width: int, rows: list[tuple[int | None, bytes]]) -> int:
    known = np.array([r[0] is not None for r in rows], bool)
    doc_id = np.array([r[0] or 0 for r in rows], np.int64)
    sizes = np.array([len(r[1]) // width for r in rows], np.int64)
    ends = np.cumsum(sizes)
    new = np.ones(len(rows), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(new)
    a, b, c = key_hashes(doc_id[first], known[first])
    moved = displacements(a, b)
    slot = _slots(a, moved[(b % _U64(len(moved))).astype(np.int64)], len(first))
    slots = np.zeros(len(first), SLOT)
    slots["fingerprint"][slot], slots["first"][slot] = (c >> _U64(32)).astype("<u4"), first
    slots["begin"][slot], slots["size"][slot] = (ends - sizes)[first], sizes[first]
    _put(system, f"{path}.ids", [r[1] for r in rows])
    head = np.array([width, len(rows), len(first), len(moved), ends[-1]], "<i8")
    _put(system, f"{path}.idx", [x.tobytes() for x in (
        head, moved.astype("<i4"), slots, doc_id.astype("<i8"), known.astype("u1"), ends.astype("<u8"))])
    return int(ends[-1])


class _Ranges:
    """Range number of each row, ascending with doc_id, null ids first.

    ``hot``: ids (or None) that many rows have, each with its rows and with those of each text hash that
    many of them share. Such an id is cut by text hash, and equal texts are dealt one by one.
    """

    def __init__(self, cuts: list[int], hot: dict[int | None, tuple[int, dict[int, int]]], docs_per_shard: int):
        self.cuts = self._around(cuts, [v for v in hot if v is not None])
        width = np.ones(len(self.cuts) + 2, np.int64)
        self.hot = {}
        for value, (n, copies) in hot.items():
            parts = -(-n // docs_per_shard)
            edges = self._around([-2**63 + 2**64 * i // parts for i in range(1, parts)], list(copies))
            shares = np.ones(len(edges) + 1, np.int64)
            for h, m in copies.items():
                shares[np.searchsorted(edges, h)] = -(-m // docs_per_shard)
            at = 0 if value is None else 1 + int(np.searchsorted(self.cuts, value))
            self.hot[at] = edges, shares, np.cumsum(shares) - shares
            width[at] = shares.sum()
        self.first = np.cumsum(width) - width

    @staticmethod
    def _around(cuts: list[int], alone: list[int]) -> np.ndarray:
        """Upper limits of ranges, those of ``alone`` in a range of their own."""
        return np.array(sorted({*cuts, *alone, *(v - 1 for v in alone if v > -2**63)}), np.int64)

    def places(self, doc_id: np.ndarray, known: np.ndarray, text_hash: np.ndarray, row: np.ndarray) -> np.ndarray:
        at = np.where(known, 1 + np.searchsorted(self.cuts, doc_id), 0)
        out = self.first[at]
        for i in np.unique(at).tolist():
            if i in self.hot:
                edges, shares, first = self.hot[i]
                here = np.flatnonzero(at == i)
                part = np.searchsorted(edges, text_hash[here])
                out[here] += first[part] + row[here] % shares[part]
        return out.astype(np.int32)


def _hot(docs: DataFrame, values: list[int], nulls: bool, docs_per_shard: int) -> dict[int | None, tuple[int, dict[int, int]]]:
    """For each of the ids (and null) its rows, and those of each text hash that more than a shard's rows have."""
    if not values and not nulls:
        return {}
    own = texts(docs).where(F.col("doc_id").isin(values) | (F.lit(nulls) & F.col("doc_id").isNull()))
    each = own.groupBy("doc_id", document_hash(F.col("text")).alias("h")).count()
    sizes = {r["doc_id"]: r["n"] for r in each.groupBy("doc_id").agg(F.sum("count").alias("n")).collect()}
    out: dict = {value: (n, {}) for value, n in sizes.items()}
    for r in each.where(F.col("count") > docs_per_shard).collect():  # fewer than shards
        out[r["doc_id"]][1][r["h"]] = r["count"]
    return out


def _limits(keys: DataFrame, n: int, ranges: int) -> list[int]:
    """Upper limits that part the ids into ``ranges`` of about equal size, from a sample."""
    wanted = SAMPLE_PER_RANGE * ranges
    found = keys if n <= wanted else keys.sample(min(1.0, wanted / n), seed=1)
    ordered = np.sort(found.toArrow().column(0).to_numpy())
    places = np.arange(1, ranges) * len(ordered) // ranges
    return ordered[places].tolist() if len(ordered) else []


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1,
                      docs_per_shard: int = DOCS_PER_SHARD, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Writes all documents' ids, each with ``end_id`` after it, in ascending doc_id order.

    Returns the manifest: shard (ascending), path, n_docs, n_ids, first_id, last_id (null if all are), n_null, start
    (ids in earlier shards).
    Documents are dealt by ranges of doc_id, of about ``docs_per_shard`` documents each; the limits
    come from a sample of the ids, of ``SAMPLE_PER_RANGE`` a range, and a range is written as one or more shards, each
    of at most ``2 * docs_per_shard`` documents and, but for its last one, ``IDS_PER_SHARD`` ids. An id, or null,
    with more rows than two shards or so has several ranges, by text hash, and a shard may end within an
    id. A null text is empty. Null ids come first; rows that repeat a doc_id follow each other, in the
    order of their ids' bytes within a range, and the index leads to a shard's first. No documents give
    no files. A task that runs again writes the same files again.
    """
    spark = docs.sparkSession
    width = 2 if word_tokenizer(tokenizer).size <= 1 << 16 and end_id < 1 << 16 else 4
    keys = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    n, known = keys.agg(F.count("*"), F.count("doc_id")).first()
    ranges = max(1, -(-n // docs_per_shard))
    cuts = _limits(keys.where("doc_id IS NOT NULL"), known, ranges) if ranges > 1 else []
    # An id with many ranges' rows is several cuts; one that the sample missed has one range, which is many shards.
    often = [v for v, times in Counter(cuts).items() if times > 1]
    hot = _hot(docs, often, n - known > docs_per_shard, docs_per_shard)
    where = _Ranges(cuts, hot, docs_per_shard)
    own = texts(docs)
    is_hot = F.col("doc_id").isin(often) | F.col("doc_id").isNull()
    own = own.withColumn("h", F.when(is_hot, document_hash(F.col("text"))).otherwise(0) if hot else F.lit(0).cast("long"))

    def dealt(batches):
        tokenised = token_ids(tokenizer, end_id)
        task = TaskContext.get()
        row = 7919 * task.partitionId() if task else 0  # tasks begin with different shares of equal texts
        for batch in slices(batches):
            doc = batch.column(0)
            place = where.places(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False),
                                 batch.column(2).to_numpy(), row + np.arange(len(doc)))
            row += len(doc)
            at = 0
            for part in tokenised([batch]):
                ids = part["ids"]
                if width == 2:
                    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
                    values = np.frombuffer(ids.buffers()[2], "<u4")[ends[0] // 4:ends[-1] // 4].astype("<u2")
                    ids = binary_array(values, (ends - ends[0]) // 4)
                yield {"range": pa.array(place[at:at + len(ids)]), "doc_id": part["doc_id"], "ids": ids}
                at += len(ids)

    def stored(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        rows: list[tuple[int | None, bytes]] = []
        at, part, held = None, 0, 0

        def close():
            path = f"shard-{at:08d}-{part:04d}"
            n_ids = _write_shard(system, f"{base}/{path}", width, rows)
            own = [doc for doc, _ in rows if doc is not None]  # ascending
            return {"shard": [at * 10_000 + part], "path": [path], "n_docs": [len(rows)], "n_ids": [n_ids],
                    "first_id": own[:1] or [None], "last_id": own[-1:] or [None], "n_null": [len(rows) - len(own)]}

        for batch in slices(batches, 2):
            for place, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (place != at or len(rows) >= 2 * docs_per_shard or held >= ids_per_shard * width):
                    yield close()
                    part = part + 1 if place == at else 0
                    rows, held = [], 0
                at = place
                rows.append((doc, ids))
                held += len(ids)
        if rows:
            yield close()

    ids = map_rows(own, dealt, "range int, doc_id long, ids binary")
    ordered = ids.repartition("range").sortWithinPartitions("range", "doc_id", "ids")
    made = map_rows(ordered, stored, MANIFEST)
    made.write.parquet(f"{folder.rstrip('/')}/manifest")
    shards = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; ids as little-endian unsigned 32-bit integers.

    Shards are read one at a time in a task; where a document's ids are is what the index has for its key.
    """
    def run(batches):
        system, base = _file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(system, f"{base}/{path}")
                doc_id, known, begin, size = shard.documents()
                ids = np.concatenate([shard.payload[a:a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]).astype("<u4")
                yield {"doc_id": pa.array(doc_id, mask=~known), "start": pa.array(start + begin),
                       "ids": binary_array(ids, np.concatenate([[0], np.cumsum(size)]))}

    shards = manifest.count()  # a task for each, which adaptive execution would join to a few
    return map_rows(manifest.select("path", "start").repartition(max(1, shards), "path"), run,
                    "doc_id long, start long, ids binary")


def routed(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, path): each wanted key once with every shard whose ids it lies between.

    The manifest's limits, a line a shard, travel to the keys if their counted size allows, else both are joined.
    """
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    shards = manifest.select("path", "first_id", "last_id", "n_null")
    inside = (F.col("doc_id") >= F.col("first_id")) & (F.col("doc_id") <= F.col("last_id")) | (F.col("doc_id").isNull() & (F.col("n_null") > 0))
    return wanted.join(F.broadcast(shards) if fits_broadcast(shards) else shards, inside).select("doc_id", "path")


def look_up(manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted keys, a column doc_id, that are there; keys that repeat are answered once.

    A key goes to the shards whose limits it lies between, and each reads a few bytes of its index and the key's own
    ids. Of an id's rows the first one in the files is the answer.
    """
    def run(batches):
        system, base = _file_system(folder)
        at, shard = None, None
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "path": [], "ids": []}
            for doc, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != at:
                    if shard is not None:
                        shard.close()
                    at, shard = path, KeyedShard(system, f"{base}/{path}")
                ids = shard.get(doc)
                if ids is not None:
                    for column, value in zip(out.values(), (doc, path, ids.astype("<u4").tobytes()), strict=True):
                        column.append(value)
            yield out
        if shard is not None:
            shard.close()

    found = map_rows(routed(manifest, keys).repartition("path").sortWithinPartitions("path", "doc_id"), run,
                     "doc_id long, path string, ids binary")
    return found.groupBy("doc_id").agg(F.min_by("ids", "path").alias("ids"))  # names of shards ascend


def token_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-files")
