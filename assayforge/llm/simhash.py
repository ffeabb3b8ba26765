"""SimHash fingerprints of documents, and near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import document_hash, fresh, map_rows, slices, texts, written
from assayforge.llm.components import components

SEED = 42
RADIUS = 3
TILE = 8192
BLOCK = 512
_ALL = np.uint64(2**64 - 1)
_BITS = np.arange(64, dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes: the top bits of a carry-save count, all 64 positions at once."""
    n = len(hashes)
    planes: list[list[np.ndarray]] = [[hashes]]
    counts: list[int] = []
    level = 0
    while level < len(planes):  # add words of equal weight three by three, the carries go one level up
        words = planes[level]
        carries: list[np.ndarray] = []
        x = np.concatenate(words) if words else np.zeros(0, np.uint64)
        while len(x) > 1:
            third = len(x) // 3
            if third == 0:
                carries.append(x[:1] & x[1:2])
                x = x[:1] ^ x[1:2]
                break
            a, b, c, rest = x[:third], x[third:2 * third], x[2 * third:3 * third], x[3 * third:]
            half = a ^ b
            carries.append(a & b | half & c)
            x = np.concatenate([half ^ c, rest])
        counts.append(int(x[0]) if len(x) else 0)
        if carries:
            planes.append(carries)
        level += 1
    # Compare the counts, bit plane by bit plane, with n // 2.
    above, same, most = 0, 2**64 - 1, n // 2
    for bit in reversed(range(max(len(counts), most.bit_length()))):
        plane = counts[bit] if bit < len(counts) else 0
        if most >> bit & 1:
            same &= plane
        else:
            above |= same & plane
            same &= ~plane
    return above


def fingerprint(text: str) -> int:
    """The 64 bits of a text: of its 3-word shingles, or its whole word sequence if shorter; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= 3:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-3] + 1).tolist()]
    return majority_bits(np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist(), strict=True)], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long. A null text is empty; each row gives a row."""
    own = texts(docs).withColumn("text_hash", document_hash(F.col("text")))

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array(found.view(np.int64))}

    return map_rows(own, run, "doc_id long, text_hash long, fp long")


def near_rows(fps: np.ndarray, radius: int) -> np.ndarray:
    """For every row the rows within the radius, as bits of a vector of 64-bit words.

    Fingerprints lie in bit planes: word w of plane b has bit b of fingerprints 64w to 64w + 63. All
    distances of a row are counted at once, three planes a step, by carry-save adders; a word of 64
    fingerprints is given up once all of them are beyond the radius.
    """
    n = len(fps)
    width = -(-n // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, :n] = (fps[None, :] >> _BITS[:, None]) & np.uint64(1)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    valid = np.packbits(np.arange(width * 64) < n, bitorder="little").view(np.uint64)
    counters = (radius + 1).bit_length()  # counts above this many bits are kept as "beyond"
    out = np.zeros((n, width), np.uint64)
    for start in range(0, n, BLOCK):
        rows = fps[start:start + BLOCK]
        # A pair of (row, word) still alive, as a flat list.
        word = np.tile(np.arange(width), len(rows))
        row = np.repeat(np.arange(len(rows)), width)
        count = [np.zeros(len(word), np.uint64) for _ in range(counters)]
        beyond = ~valid[word]
        for bit in range(0, 64, 3):
            diff = [planes[b, word] ^ (_ALL * (rows[row] >> np.uint64(b) & np.uint64(1)))
                    for b in range(bit, min(64, bit + 3))]
            if len(diff) == 3:
                half = diff[0] ^ diff[1]
                ones, twos = half ^ diff[2], diff[0] & diff[1] | half & diff[2]
            else:
                ones, twos = diff[0], np.zeros_like(diff[0])
            for level, carry in ((0, ones), (1, twos)):
                for k in range(level, counters):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                beyond |= carry
            if bit % 9 == 6:
                over = beyond.copy()  # of all bits of the count: is it above the radius?
                above, same = np.zeros_like(over), np.full_like(over, _ALL)
                for k in reversed(range(counters)):
                    if radius >> k & 1:
                        same &= count[k]
                    else:
                        above |= same & count[k]
                        same &= ~count[k]
                alive = (over | above) != _ALL
                if not alive.all():
                    word, row, beyond = word[alive], row[alive], beyond[alive]
                    count = [c[alive] for c in count]
                    if not len(word):
                        break
        if len(word):
            above, same = beyond.copy(), np.full_like(beyond, _ALL)
            for k in reversed(range(counters)):
                if radius >> k & 1:
                    same &= count[k]
                else:
                    above |= same & count[k]
                    same &= ~count[k]
            out[start + row, word] = ~above
    return out


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, first row of its component) that join what the bit rows join."""
    n = len(near)
    open_rows = np.packbits(np.arange(near.shape[1] * 64) < n, bitorder="little").view(np.uint64).copy()
    links = []
    alone = (np.bitwise_count(near).sum(1) <= 1).tolist()
    for first in range(n):
        if alone[first] or not int(open_rows[first >> 6]) >> (first & 63) & 1:
            continue
        open_rows[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        stack = [first]
        while stack:
            found = near[stack.pop()] & open_rows
            if found.any():
                open_rows &= ~found
                new = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist()
                stack += new
                links += [(row, first) for row in new]
    return links


def _tables(fp: Column) -> Column:
    """The 16 keys of a fingerprint: a 16-bit part, a 12-bit part of the rest, and which parts these are."""
    keys = []
    for part in range(4):
        whole = F.shiftrightunsigned(fp, 16 * part).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * part) - 1) if part else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * part + 16), 16 * part) if part < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for piece in range(4):
            value = F.shiftrightunsigned(rest, 12 * piece).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(whole, 16).bitwiseOR(F.shiftleft(value, 4)).bitwiseOR(F.lit(4 * part + piece)))
    return F.array(*keys)


def links(fps: DataFrame, *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints that join all pairs within ``radius`` (3 at most).

    Two fingerprints that differ in at most three bits agree in one of four 16-bit parts, and of the
    48 other bits in one of four 12-bit parts: 16 tables of 28-bit keys hold every pair. Rows of one
    key are compared with each other, bit-sliced. A key with more than ``tile`` rows is cut into
    chunks, and each pair of chunks is a task's work of its own. Only links that join what a
    comparison finds are returned, fewer than rows, so a dense group gives no square of links.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    keyed = fps.select("fp", F.explode(_tables(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1),
                        lambda other: F.least(own, other) * F.lit(65536) + F.greatest(own, other))
    dealt = keyed.join(large, "key", "left").select(
        "fp", "key", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("chunk"))

    def run(batches) -> Iterator[dict]:
        held_fp, held_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def compared(fp: np.ndarray, key: np.ndarray) -> dict | None:
            start = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(start) - 1
            many = np.bincount(group)[group] > 1
            fp, group = fp[many], group[many]
            a, b = [], []
            at = 0
            while at < len(fp):  # whole keys, as many as fill a block
                end = int(np.searchsorted(group, group[min(at + BLOCK, len(fp)) - 1], "right"))
                if end - at > BLOCK and group[at] != group[end - 1]:
                    end = int(np.searchsorted(group, group[end - 1], "left"))
                own = np.unique(fp[at:end])
                for i, first in spanning_links(near_rows(own, radius)):
                    a.append(own[i])
                    b.append(own[first])
                at = end
            return {"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))}

        for batch in batches:
            key = batch.column(1).to_numpy() * np.int64(1 << 31) + batch.column(2).to_numpy()
            fp = np.concatenate([held_fp, batch.column(0).to_numpy().view(np.uint64)])
            key = np.concatenate([held_key, key])
            if not len(key):
                continue
            cut = int(np.flatnonzero(key == key[-1])[0])
            held_fp, held_key = fp[cut:], key[cut:]  # the last key may go on in the next batch
            if cut:
                yield compared(fp[:cut], key[:cut])
        if len(held_fp):
            yield compared(held_fp, held_key)

    ordered = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    return map_rows(ordered, run, "a long, b long").distinct()


def _groups(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and (fp, first, root): the smallest doc_id that has it, and its group's name."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(distinct.select("fp"), radius=radius))
    return rows, distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    fingerprint: 16 lowercase hex digits. Documents are linked if their fingerprints differ in at most
    ``radius`` bits; component_id is the smallest doc_id that links reach, the document's own included.
    A null text is empty; a text without words has fingerprint zero and is linked like any other.
    Repeated rows give rows each; a null doc_id never names a component unless all its ids are null.
    No rows give no rows. Equal fingerprints are compared once, however many documents share them.
    """
    rows, named = _groups(docs, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest doc_id.

    Of several texts with that doc_id, the one with the smallest hash stays, and of rows that repeat
    doc_id and text, one. Null doc_ids come last: such a document stays only where its group has no
    other id. Groups are those of the texts, so unlike texts with equal or null ids all stay.
    """
    rows, named = _groups(docs, radius)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    least = rows.groupBy("fp").agg(F.min(place).alias("least")).join(named, "fp").groupBy("root").agg(
        F.min("least").alias("least"))
    key, doc, text_hash = (fresh(docs, name) for name in ("_text_hash", "_id", "_hash"))
    keep = least.select(F.col("least.doc_id").alias(doc), F.col("least.text_hash").alias(text_hash))
    marked = docs.withColumn(key, document_hash(docs["text"]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash))
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
