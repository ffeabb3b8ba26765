"""Packing of documents into sequences of near-equal fill by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assayforge.llm.batches import map_rows, slices, texts
from assayforge.llm.tokens import IDS, token_ids

CAPACITY = 4096
GROUP_PIECES = 256

Piece = tuple[int, int, int]  # document's place in the group, start in the document, length


def differencing(lengths: Sequence[int], windows: int) -> list[list[int]]:
    """Items dealt over ``windows`` by Karmarkar-Karp multiway differencing.

    A partial partition is a list of (sum, items) with the largest sum first; windows without items
    are left out. The two partitions with the largest imbalance are merged, the fullest window of
    one with the emptiest of the other, until one partition is left.
    """
    if not lengths:
        return []
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - windows)  # windows that get items of both
        merged = a[:len(a) - shared] + b[:len(b) - shared]
        merged += [(x[0] + y[0], (x[1], y[1]))
                   for x, y in zip(a[len(a) - shared:], reversed(b[len(b) - shared:]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        imbalance = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-imbalance, made, merged))
        made += 1
    out = []
    for _, tree in heap[0][2]:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                items.append(node)
        out.append(sorted(items))
    return out


def near_equal_windows(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Fewest windows, by differencing, none of which holds more than ``capacity``."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        dealt = differencing(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in dealt):
            return dealt
        windows += max(1, windows // 100)


def _fill(room: int, spare: list[Piece]) -> list[Piece]:
    """Takes ``room`` ids from the spare pieces, cutting the last one taken."""
    taken = []
    while room:
        doc, start, length = spare.pop()
        part = min(room, length)
        taken.append((doc, start, part))
        if part < length:
            spare.append((doc, start + part, length - part))
        room -= part
    return taken


def pack_group(pieces: list[Piece], capacity: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of exactly ``capacity`` ids, and the pieces that are left for the next group.

    Near-equal windows are made first. The fullest of them, as many as the ids can fill, are topped
    up to the capacity from the others. In the ``last`` group the rest is cut into sequences whose
    lengths are different powers of two, which need no padding either.
    """
    lengths = [p[2] for p in pieces]
    windows = near_equal_windows(lengths, capacity) if pieces else []
    windows.sort(key=lambda w: -sum(lengths[i] for i in w))
    full = sum(lengths) // capacity
    spare = [pieces[i] for w in windows[full:] for i in w]
    sequences = []
    for w in windows[:full]:
        own = [pieces[i] for i in w]
        sequences.append(own + _fill(capacity - sum(p[2] for p in own), spare))
    if last:
        rest = sum(p[2] for p in spare)
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                sequences.append(_fill(1 << bit, spare))
        spare = []
    return sequences, spare


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 2,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` token ids; returns their pieces.

    Columns: doc_id, start (the document's ids before the piece), length, ids (the piece's ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (place in the sequence).

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Whole
    sequences of a longer document stand alone. What remains is packed in groups of ``group_pieces``
    by multiway differencing, inside the partition that read it: no shuffle, and a task holds one
    group. Every sequence holds ``capacity`` ids or, at a partition's end, a power of two.
    Each row counts: rows with the same doc_id are packed each for itself, null ids too. Ties are
    broken by the order of rows. No rows give no pieces. Sequence ids are unique, not gapless.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches) -> Iterator[dict[str, list]]:
        next_id = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        pieces: list[Piece] = []

        def rows(sequences: list[list[Piece]]) -> dict[str, list]:
            nonlocal next_id
            out: dict[str, list] = {k: [] for k in (
                "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for sequence in sequences:
                offset = 0
                for doc, start, length in sequence:
                    doc_id, ids = held[doc]
                    for name, value in zip(out, (doc_id, start, length, ids[4 * start:4 * (start + length)],
                                                 len(ids) // 4, next_id, offset), strict=True):
                        out[name].append(value)
                    offset += length
                next_id += 1
            return out

        for batch in slices(batches):
            whole: list[list[Piece]] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(ids) // 4
                held.append((doc_id, ids))
                cut = n - n % capacity
                whole += [[(len(held) - 1, at, capacity)] for at in range(0, cut, capacity)]
                if cut < n:
                    pieces.append((len(held) - 1, cut, n - cut))
            if whole:
                yield rows(whole)
            if len(pieces) >= group_pieces:
                sequences, pieces = pack_group(pieces, capacity, last=False)
                yield rows(sequences)
                kept = sorted({p[0] for p in pieces})
                place = {doc: i for i, doc in enumerate(kept)}
                held = [held[doc] for doc in kept]
                pieces = [(place[doc], start, length) for doc, start, length in pieces]
        yield rows(pack_group(pieces, capacity, last=True)[0])

    return map_rows(texts(docs), token_ids(tokenizer, end_id), IDS, run,
                    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
