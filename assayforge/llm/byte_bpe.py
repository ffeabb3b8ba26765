"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

A sequence of tokens is what the merges give if and only if each pair of neighbours is: the merges of
their bytes alone give that pair. So a piece is encoded left to right with the longest token that fits
its neighbour, going back to shorter ones where no token fits. A position from which no encoding goes
on is marked and never tried again, which keeps the time linear.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from assayforge.llm.batches import Memo, Rows, binary_array, gathered, map_rows, per_worker, slices, texts

MEMO_CHUNKS = 120_000
MEMO_PAIRS = 300_000
LONGEST_MEMO = 64
_SPACE_BEFORE_SPACE = (r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
                       r"\x{3000}]|\z)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import ahocorasick

        self.split = regex.compile(pattern)
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        self.shorter: list[int | None] = [None] * size  # the longest shorter token that starts a token
        self.halves = [(rank, rank) for rank in range(size)]  # what the last merge of a token joins
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo = Memo(MEMO_CHUNKS)
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.matches = ahocorasick.Automaton()  # of every start of a token: the longest token in it
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.bytes_of[rank] = token
            halves = self._last_merge(token, rank)
            if halves:
                self.halves[rank], self.pairs[halves] = halves, rank
        for token, rank in self.ranks.items():
            longest = None
            for n in range(1, len(token) + 1):
                own = self.ranks.get(token[:n])
                if n == len(token):
                    self.shorter[rank] = longest
                longest = longest if own is None else own
                self.matches.add_word(token[:n].decode("latin-1"), longest)
        self.longest_token = max(map(len, self.ranks))
        self.length = [len(token or b"") for token in self.bytes_of]
        self.packed = [np.uint32(rank).tobytes() for rank in range(size)]

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair of tokens that the merges make of ``token`` before the last; None where they make no pair."""
        for n in range(1, len(token)):
            left, right = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if left is not None and right is not None and left < rank and right < rank and self.fits(left, right):
                return left, right
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give just these two tokens.

        Takes back merges, the later one first, and looks whether an earlier merge across the border
        would have come before.
        """
        bound = len(self.ranks)
        while True:
            joint = self.pairs.get((left, right))
            if joint is not None and joint < bound:
                return False
            later_left = left > right
            for _ in range(2):
                if later_left:
                    part = self.halves[left][1]
                    if part != left:
                        bound, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        bound, right = right + 1, part
                        break
                later_left = not later_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        prefix, token_at, length, shorter, fits = (
            self.matches.longest_prefix, self.matches.get, self.length, self.shorter, self.fits_memo)
        longest_token = self.longest_token
        n, at, out, dead = len(text), 0, [], set()
        token = token_at(text[:prefix(text)])
        while True:
            end = at + length[token]
            if end not in dead:
                good = True
                if out:
                    pair = (out[-1], token)
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= MEMO_PAIRS:
                            fits.clear()
                        good = fits[pair] = self.fits(*pair)
                if good:
                    out.append(token)
                    if end == n:
                        return out
                    at = end
                    rest = text[at:at + longest_token]
                    token = token_at(rest[:prefix(rest)])
                    continue
            token = shorter[token]
            while token is None:  # nothing goes on from here: shorten the token before
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        known = self.memo
        found = known.find(chunks)
        split, packed = self.split.findall, self.packed
        for i, ids in enumerate(found):
            if ids is None:
                chunk, parts = chunks[i], []
                for piece in split(chunk):
                    ids = known.get(piece) or known.older.get(piece)
                    if ids is None:
                        ids = b"".join([packed[t] for t in self.encode_piece(piece.encode())])
                        if len(piece) <= LONGEST_MEMO:
                            known[piece] = ids
                    parts.append(ids)
                found[i] = ids = parts[0] if len(parts) == 1 else b"".join(parts)
                if len(parts) > 1 and len(chunk) <= LONGEST_MEMO:
                    known[chunk] = ids
        return found

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin, with the end of the last."""
        odd = pc.match_substring_regex(batch, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False)
        ids, offsets = self._cut_at_spaces(batch.filter(pa.array(~odd)))
        if not odd.any():
            return ids, offsets
        rows = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        for at, text in zip(np.flatnonzero(odd).tolist(), batch.filter(pa.array(odd)).to_pylist(), strict=True):
            own = b"".join(self._chunks(self._parts(text)))
            rows.insert(at, np.frombuffer(own, "<u4"))
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def _cut_at_spaces(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts in which each space stands before a character other than white space.

        A match of the pattern begins at each such space, so these texts can be cut there.
        """
        cut = pc.split_pattern(batch, " ")
        places = cut.offsets.to_numpy().astype(np.int64)
        parts = cut.values.slice(places[0], places[-1] - places[0]).dictionary_encode()
        places = places - places[0]
        words = parts.dictionary.to_pylist()
        index = parts.indices.to_numpy().copy()
        heads = places[:-1]  # every text has a first part, and no space before it
        own, index[heads] = np.unique(index[heads], return_inverse=True)
        index[heads] += len(words)
        ids, sizes = gathered(self._chunks([" " + w for w in words] + [words[i] for i in own.tolist()]), index)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[places]

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Any text, cut before the spaces that stand before a character other than white space."""
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    return per_worker(("byte BPE", path, pattern), lambda: ByteBpe(path, pattern))


def _encoding(ranks: str, pattern: str) -> Rows:
    def run(batches):
        coder = byte_bpe(ranks, pattern)
        for batch in slices(batches):
            yield {"doc_id": batch.column(0), "ids": binary_array(*coder.encode(batch.column(1)))}

    return run


def _decoding(ranks: str, pattern: str) -> Rows:
    def run(batches):
        coder = byte_bpe(ranks, pattern)
        for batch in slices(batches):
            yield {"doc_id": batch.column(0), "ids": batch.column(1),
                   "decoded": [coder.decode(i or b"") for i in batch.column(1).to_pylist()]}

    return run


IDS, DECODED = "doc_id long, ids binary", "doc_id long, ids binary, decoded binary"


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Each row gives one row, with null or repeated doc_id too; other
    columns are left out. No rows give no rows.
    """
    return map_rows(texts(docs), _encoding(ranks, pattern), IDS)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids beside them; null ids count as none."""
    return map_rows(encoded.select("doc_id", "ids"), _decoding(ranks, pattern), DECODED)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one pass."""
    return map_rows(texts(docs), _encoding(ranks, pattern), IDS, _decoding(ranks, pattern), DECODED)
