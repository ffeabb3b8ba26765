"""Token ids of the lower-casing word tokenizer, with a memo of the pieces that its pattern cuts.

No token of that tokenizer crosses white space, so the ids of a text are those of its chunks in
order. A batch's different chunks of plain Latin letters, digits and signs are lower-cased and cut by
the tokenizer's own pattern in Arrow. A piece seen before costs one dictionary look-up; unseen ones are
merged together, many pieces in one array; the merge list is read from the tokenizers library. All other
chunks go through the library.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assayforge.llm.batches import Memo, Rows, binary_array, gathered, per_worker, runs_of, slices

MEMO_PIECES = 120_000
LONGEST_CUT = 48
TABLE_BITS = 20
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
# Fixed value: the tokenizer's pre-split, for plain chunks.
_PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Merges of many short pieces at once: each round merges, in every piece, its lowest-ranked pair."""

    def __init__(self, pairs: Sequence[tuple[int, int, int]], first: np.ndarray, last: np.ndarray):
        """``pairs``: (left, right, merged) with merged ids in the order of the merges; ``first`` and
        ``last``: the id of each byte inside a piece and at its end."""
        self.first, self.last = first, last
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.uint64)
        made = np.array([m for _, _, m in pairs], np.int32)
        at = self._slot(keys)
        self.keys = np.full(1 << TABLE_BITS, np.uint64(2**64 - 1))
        self.made = np.full(1 << TABLE_BITS, _NONE)
        self.keys[at], self.made[at] = keys, made  # of keys in one slot, the last stays
        lost = self.keys[at] != keys
        self.crowded = np.zeros(1 << TABLE_BITS, bool)
        self.crowded[at[lost]] = True
        order = np.argsort(keys[lost])
        self.rest_keys = np.append(keys[lost][order], np.uint64(2**64 - 1))
        self.rest_made = np.append(made[lost][order], _NONE)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, or a larger number than any id."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.made[at], _NONE)
        look = ~hit & self.crowded[at]
        if look.any():
            place = np.searchsorted(self.rest_keys, keys[look])
            out[look] = np.where(self.rest_keys[place] == keys[look], self.rest_made[place], _NONE)
        return out

    def _same_width(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = self.first[text]
        ids[np.arange(n), size - 1] = self.last[text[np.arange(n), size - 1]]
        made = self.merged(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), _NONE)
        made[np.arange(width - 1) >= (size - 1)[:, None]] = _NONE
        out_ids, out_size = np.zeros((n, width), "<u4"), size.copy()
        rows = np.arange(n)
        columns = np.arange(width)
        while len(rows) and width > 1:
            j = made.argmin(1)
            best = made[np.arange(len(rows)), j]
            over = best == _NONE
            if over.any():
                out_ids[rows[over]] = ids[over]
                out_size[rows[over]] = size[over]
                go = ~over
                rows, ids, made, size, j, best = rows[go], ids[go], made[go], size[go], j[go], best[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, j] = best
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > j[:, None]), width - 1), 1)
            made = np.take_along_axis(made, np.minimum(columns[:-1] + (columns[:-1] > j[:, None]), width - 2), 1)
            size = size - 1
            made[:, -1] = _NONE
            right = j < size - 1
            made[k, j] = _NONE
            made[k[right], j[right]] = self.merged(ids[k[right], j[right]], ids[k[right], j[right] + 1])
            left = j > 0
            made[k[left], j[left] - 1] = self.merged(ids[k[left], j[left] - 1], ids[k[left], j[left]])
        if width == 1:
            out_ids = ids.astype("<u4")
        flat, stride = out_ids.tobytes(), 4 * width
        return [flat[i * stride:i * stride + 4 * m] for i, m in enumerate(out_size.tolist())]

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_width.setdefault(-(-len(piece) // 4) * 4 if len(piece) > 1 else 1, []).append(i)
        for width, places in by_width.items():
            for i, ids in zip(places, self._same_width([pieces[i] for i in places], width), strict=True):
                out[i] = ids
        return out


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.whole.get_vocab_size()
        model = json.loads(self.whole.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
                             np.array([vocab[letters[b]] for b in range(256)], np.int32),
                             np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32))
        self.memo = Memo(MEMO_PIECES)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        found = self.memo.find(pieces)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        new = [pieces[i] for i in unseen]
        for i, ids in zip(unseen, self.merges([p.encode() for p in new]), strict=True):
            found[i] = ids
        self.memo.update(zip(new, [found[i] for i in unseen], strict=True))
        return found

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks in a row, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.less_equal(pc.utf8_length(chunks), LONGEST_CUT))
        is_plain = plain.to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(
            pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _PIECES, r"\1 ")))
        coded = cut.flatten().dictionary_encode()
        own, each = gathered(self._pieces(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        other = [np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u4")
                 for c in chunks.filter(pc.invert(plain)).to_pylist()]
        if not other:
            return own, np.diff(np.concatenate([[0], np.cumsum(each)])[cut.offsets.to_numpy()])
        sizes = np.zeros(len(chunks), np.int64)
        sizes[is_plain] = np.diff(np.concatenate([[0], np.cumsum(each)])[cut.offsets.to_numpy()])
        sizes[~is_plain] = [len(ids) for ids in other]
        ids, from_plain = np.zeros(sizes.sum(), "<u4"), np.repeat(is_plain, sizes)
        ids[from_plain], ids[~from_plain] = own, np.concatenate(other)
        return ids, sizes

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin, with the end of the last."""
        split = pc.ascii_split_whitespace(batch)
        places = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(places[0], places[-1] - places[0]).dictionary_encode()
        ids, sizes = runs_of(*self._chunks(words.dictionary), words.indices.to_numpy())
        return ids, np.concatenate([[0], np.cumsum(sizes)])[places - places[0]]


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return per_worker(("word tokenizer", path), lambda: WordTokenizer(path))


IDS = "doc_id long, ids binary"


def token_ids(tokenizer: str, end_id: int) -> Rows:
    """A step from (doc_id, text) to (doc_id, ids), for ``map_rows``.

    ids: each whole text's ids and the end id, as little-endian unsigned 32-bit integers. An empty text
    gives the end id alone; every row gives one row.
    """
    def run(batches):
        encode = word_tokenizer(tokenizer).encode
        for batch in slices(batches):
            ids, offsets = encode(batch.column(1))
            ids = np.insert(ids, offsets[1:], end_id)
            yield {"doc_id": batch.column(0), "ids": binary_array(ids, offsets + np.arange(len(offsets)))}

    return run
