"""Near copies of documents: bit-sliced SimHash comparison for candidates, exact shingle similarity for the verdict.

Texts of the same words in a row are one node. A node's fingerprint gives a key of a few sampled bits for each of
several tables, within a band of lengths; nodes of one key are compared bit-sliced, and those within the radius are
candidates. Each candidate's most alike partners by a sketch are then compared by all their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import document_hash, fresh, map_rows, slices, texts, written
from assayforge.llm.components import components
from assayforge.llm.simhash import BLOCK, TILE, majority_bits

WORDS = 5  # of the shingles that decide
FINGERPRINT_WORDS = 3  # of those that make fingerprints: a changed word changes fewer of them
SIMILARITY = 0.8
FINGERPRINT = 128  # bits: with 64, a few in a thousand unlike texts of one key are within the radius
RADIUS = 28  # texts of similarity 0.8 differ in 14 to 20 bits of 128, very seldom in more than 28
FAR = 20  # bits of difference up to which the tables find a pair with probability FOUND
FOUND = 0.95
LEAST_BITS = 10  # of a key
NODES_PER_KEY = 2048  # about so many lie in one key at most: longer keys, and more tables, for more nodes
BAND = math.log(1.4)  # lengths of similar texts are at most one band apart
SLOTS = 256  # of a sketch, a byte each
SLACK = 0.15  # below the similarity, for the sketch's error
PARTNERS = 2  # of each row in each group, besides those of a spanning forest
SEED = 42
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 2**63, SLOTS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of a text's shingles in order; of the whole sequence if it is shorter."""
    import xxhash

    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)], np.uint64)


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    return np.unique(_hashes(words, size))


def wide_fingerprint(words: list[bytes]) -> tuple[int, int]:
    """128 bits, each set if it is in over half of the hashes of the three-word shingles: from each hash and a mix of it."""
    h = _hashes(words, FINGERPRINT_WORDS)
    x = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return majority_bits(h), majority_bits(x ^ x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of the least of all hashes under each of ``SLOTS`` multipliers; equal bytes estimate the similarity."""
    least = np.full(SLOTS, 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[start:start + 4096, None] * _MULTIPLIERS).min(0))
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, low, high, n_words) of every row; ``node`` is a hash of the words in a row."""
    own = texts(docs).withColumn("text_hash", document_hash(F.col("text")))

    def run(batches) -> Iterator[dict]:
        import xxhash

        for batch in slices(batches):
            words = [t.encode().lower().split() for t in batch.column(1).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED + 1) for w in words], np.uint64)
            fps = np.array([wide_fingerprint(w) for w in words], np.uint64).reshape(len(words), 2)
            yield {"doc_id": batch.column(0), "text_hash": batch.column(2), "node": pa.array(node.view(np.int64)),
                   "low": pa.array(fps[:, 0].copy().view(np.int64)), "high": pa.array(fps[:, 1].copy().view(np.int64)), "n_words": pa.array([len(w) for w in words], pa.int64())}

    return map_rows(own, run, "doc_id long, text_hash long, node long, low long, high long, n_words long")


def sampled_bits(nodes: int) -> list[list[int]]:
    """The fingerprint bits of each table's key, for so many nodes.

    As many tables as it takes for a pair that differs in ``FAR`` bits to agree on a key with probability ``FOUND``.
    """
    size = max(LEAST_BITS, math.ceil(math.log2(max(1, nodes) / (8 * NODES_PER_KEY))))  # nodes lie in about 8 bands
    agree = math.comb(FINGERPRINT - FAR, size) / math.comb(FINGERPRINT, size)
    tables = math.ceil(math.log(1 - FOUND) / math.log(1 - agree))
    rng = np.random.default_rng(SEED)
    return [sorted(rng.permutation(FINGERPRINT)[:size].tolist()) for _ in range(tables)]


def _keyed(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(key, node, low, high): a line for each table and for both bands that a node's length belongs to."""
    def run(batches) -> Iterator[dict]:
        for batch in batches:
            node, low, high, n_words = (c.to_numpy() for c in batch.columns)
            band = np.floor(np.log(np.maximum(n_words, 1)) / BAND).astype(np.int64)
            out = []
            for number, bits in enumerate(tables):
                value = np.zeros(len(node), np.int64)
                for place, bit in enumerate(bits):
                    value |= ((high if bit >= 64 else low) >> np.int64(bit % 64) & np.int64(1)) << np.int64(place)
                out += [((band + step) * len(tables) + number << len(bits)) | value for step in (0, 1)]
            yield {"key": pa.array(np.concatenate(out))} | {
                name: pa.array(np.tile(x, len(out))) for name, x in (("node", node), ("low", low), ("high", high))}

    return map_rows(nodes.select("node", "low", "high", "n_words"), run, "key long, node long, low long, high long")


def _grouped(batches, columns: int) -> Iterator[list]:
    """The rows of whole (key, chunk) groups, several small ones together: lists of columns, key and chunk first."""
    held = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:columns]]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        key = held[0]
        if not len(key):
            continue
        last = np.flatnonzero((key == key[-1]) & (held[1] == held[1][-1]))[0]  # it may go on in the next batch
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _blocks(key: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, group of each row) of about ``BLOCK`` rows in whole groups of two rows or more."""
    start = np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]
    group = np.cumsum(start) - 1
    at = 0
    while at < len(key):
        end = int(np.searchsorted(group, group[min(at + BLOCK, len(key)) - 1], "right"))
        if end - at > BLOCK and group[at] != group[end - 1]:
            end = int(np.searchsorted(group, group[end - 1], "left"))
        yield at, end, group[at:end]
        at = end


def near_rows(low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """For every row the rows within the radius, as bits of a vector of 64-bit words.

    The fingerprints lie in 128 bit planes; a row's distances from 64 others are counted at once by carry-save adders,
    three planes a step, and given up once all 64 are beyond the radius.
    """
    n = len(low)
    width = -(-n // 64)
    bits = np.zeros((FINGERPRINT, width * 64), np.uint8)
    for at, half in ((0, low), (64, high)):
        bits[at:at + 64, :n] = half[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1)
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    every = np.uint64(2**64 - 1)
    digits = (radius + 1).bit_length()
    out = np.zeros((n, width), np.uint64)

    def above(count: list[np.ndarray], beyond: np.ndarray) -> np.ndarray:
        """Which counts are above the radius, digit by digit from the highest."""
        more, same = beyond.copy(), np.full_like(beyond, every)
        for k in reversed(range(digits)):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more

    valid = np.packbits(np.arange(width * 64) < n, bitorder="little").view(np.uint64)
    for start in range(0, n, BLOCK):
        rows = range(start, min(n, start + BLOCK))
        word, row = np.tile(np.arange(width), len(rows)), np.repeat(np.arange(start, start + len(rows)), width)
        count, beyond = [np.zeros(len(word), np.uint64) for _ in range(digits)], ~valid[word]
        for bit in range(0, FINGERPRINT, 3):
            diff = [planes[b, word] ^ (every * bits[b, row].astype(np.uint64)) for b in range(bit, min(FINGERPRINT, bit + 3))]
            diff += [np.zeros_like(diff[0])] * (3 - len(diff))
            half = diff[0] ^ diff[1]
            for level, carry in ((0, half ^ diff[2]), (1, diff[0] & diff[1] | half & diff[2])):
                for k in range(level, digits):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                beyond |= carry  # out of digits: beyond any radius
            if bit % 12 == 9 and bit > radius:
                alive = above(count, beyond) != every
                if not alive.all():
                    word, row, beyond, count = word[alive], row[alive], beyond[alive], [c[alive] for c in count]
                    if not len(word):
                        break
        if len(word):
            out[row, word] = ~above(count, beyond)
    return out


def _near(low: np.ndarray, high: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """``near_rows`` without rows of other groups and without a row itself, as a bit matrix."""
    near = near_rows(low.view(np.uint64), high.view(np.uint64), radius)
    n = len(low)
    if group[0] != group[-1]:
        same = np.zeros((n, near.shape[1] * 64), np.uint8)
        same[:, :n] = group[:, None] == group[None, :]
        near &= np.packbits(same, axis=1, bitorder="little").view(np.uint64)
    rows = np.arange(n)
    near[rows, rows >> 6] &= ~(np.uint64(1) << (rows & 63).astype(np.uint64))
    return near


def candidates(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, chunk, node, low, high) of the nodes that have another within ``radius`` in a group of theirs.

    A key with more than ``TILE`` nodes is cut into chunks, and each pair of chunks is a group.
    """
    keyed = _keyed(nodes, sampled_bits(nodes.count()))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    parts = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(own, o) * F.lit(65536) + F.greatest(own, o))
    dealt = keyed.join(large, "key", "left").select(
        "key", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("chunk"), "node", "low", "high")

    def run(batches) -> Iterator[dict]:
        for key, chunk, node, low, high in _grouped(batches, 5):
            start = np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]
            group = np.cumsum(start) - 1
            many = np.bincount(group)[group] > 1
            key, chunk, node, low, high = (x[many] for x in (key, chunk, node, low, high))
            alive = np.zeros(len(key), bool)
            for a, b, own in _blocks(key, chunk):
                alive[a:b] = _near(low[a:b], high[a:b], own, radius).any(1)
            yield {name: pa.array(x[alive]) for name, x in (("key", key), ("chunk", chunk), ("node", node), ("low", low), ("high", high))}

    ordered = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    return map_rows(ordered, run, "key long, chunk int, node long, low long, high long")


def signed(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, sketch, shingles) of the nodes in ``wanted``, from one document of each."""
    asked = nodes.join(wanted, "node", "left_semi").select(
        F.col("place.doc_id").alias("asked_id"), F.col("place.text_hash").alias("asked_hash"), "node")
    own = texts(docs).withColumn("text_hash", document_hash(F.col("text")))
    both = own.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_hash") == F.col("asked_hash"))).select(
        "node", "text").dropDuplicates(["node"])

    def run(batches) -> Iterator[dict]:
        for batch in slices(batches):
            hashes = [shingle_hashes(t.encode().lower().split()) for t in batch.column(1).to_pylist()]
            yield {"node": batch.column(0), "sketch": [sketch(h) for h in hashes], "shingles": [h.view(np.int64) for h in hashes]}

    return map_rows(both, run, "node long, sketch binary, shingles array<long>")


def alike_links(near: np.ndarray, signs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows (i < j) that are near and alike by their sketches: a maximum spanning forest, and each row's best ones.

    The forest joins whatever such pairs join, with fewer links than rows; it is grown from row to row, so that what
    is alike is worked out once for each row and no list of pairs is held.
    """
    n = len(near)
    inside, best, parent = np.zeros(n, bool), np.full(n, -1.0), np.full(n, -1)
    links: set[tuple[int, int]] = set()
    for start in np.flatnonzero(near.any(1)).tolist():
        at = -1 if inside[start] else start
        while at >= 0:
            inside[at] = True
            if parent[at] >= 0:
                links.add((min(at, int(parent[at])), max(at, int(parent[at]))))
            found = np.flatnonzero(np.unpackbits(near[at].view(np.uint8), bitorder="little"))
            alike = (signs[found] == signs[at]).mean(1)
            found, alike = found[alike >= least], alike[alike >= least]
            links.update((min(at, j), max(at, j)) for j in found[np.argsort(-alike, kind="stable")[:PARTNERS]].tolist())
            closer = ~inside[found] & (alike > best[found])
            best[found[closer]], parent[found[closer]] = alike[closer], at
            best[at] = -1.0
            at = int(best.argmax())
            at = at if best[at] >= 0 else -1
    return sorted(links)


def likely_pairs(alive: DataFrame, signatures: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: of the candidates of each group the links that join those alike by the sketch."""
    def run(batches) -> Iterator[dict]:
        for key, chunk, node, low, high, sketches in _grouped(batches, 6):
            links = []
            signs = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(key), SLOTS)
            for start, end, group in _blocks(key, chunk):
                near = _near(low[start:end], high[start:end], group, radius)
                links += [(node[start + i], node[start + j]) for i, j in alike_links(near, signs[start:end], similarity - SLACK)]
            found = np.sort(np.array(links, np.int64).reshape(len(links), 2), axis=1)
            found = np.unique(found, axis=0)
            yield {"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())}

    lines = alive.join(signatures.select("node", "sketch"), "node").select("key", "chunk", "node", "low", "high", "sketch")
    ordered = lines.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return map_rows(ordered, run, "a long, b long").distinct()


def verified(pairs: DataFrame, signatures: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingles have at least ``similarity`` in common: shared ones over all of both."""
    one, two = (signatures.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")) for side in ("a", "b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").where(
        shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def groups(docs: DataFrame, *, similarity: float = SIMILARITY, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) of every row, and (node, root, place): the node's group, and its first document."""
    rows = written(fingerprinted(docs), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = written(rows.groupBy("node").agg(F.min(place).alias("place"), *[
        F.any_value(c).alias(c) for c in ("low", "high", "n_words")]), "near-nodes")
    alive = written(candidates(nodes.where("n_words > 0"), radius), "near-candidates")
    signatures = written(signed(docs, nodes, alive.select("node").distinct()), "near-signatures")
    pairs = likely_pairs(alive, signatures, radius, similarity)
    joined = components(verified(pairs, signatures, similarity)).withColumnRenamed("node", "member")
    return rows, nodes.join(joined, F.col("node") == F.col("member"), "left").select(
        "node", F.coalesce("root", "node").alias("root"), "place")


def without_near_copies(docs: DataFrame, *, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest doc_id.

    Two texts are near copies if their different shingles of five words (A-Z lower-cased, ASCII white space
    between words; a shorter text is one shingle) have ``similarity`` in common; groups are what links of near
    copies join. Texts without words are copies of each other. A link is never drawn between less similar texts;
    one between near copies is missed where their fingerprints differ in more than ``radius`` bits or share no key,
    or where the sketches put other links before it in all keys that both share. Of several texts with
    the smallest doc_id, the one with the smallest hash stays, and of rows that repeat doc_id and text, one. Null
    doc_ids come last. No rows give no rows.
    """
    _, named = groups(docs, similarity=similarity, radius=radius)
    least = named.groupBy("root").agg(F.min("place").alias("least"))
    key, doc, text_hash = (fresh(docs, name) for name in ("_text_hash", "_id", "_hash"))
    keep = least.select(F.col("least.doc_id").alias(doc), F.col("least.text_hash").alias(text_hash))
    marked = docs.withColumn(key, document_hash(docs["text"]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash))
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
