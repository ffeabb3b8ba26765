"""Language of a text from piece probabilities of each language, summed over all segmentations.

The pieces are those of a public vocabulary, as they are; each language has a probability for every piece.
A word's probability is the sum over all ways to cut it into pieces, found by the forward algorithm, and a
text's is the product over its words. Probabilities are learnt by expectation maximisation: the expected
counts of the forward-backward algorithm over the words of all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import map_rows, per_worker, slices, written

WORD_START = "▁"  # fixed value: stands before a word in the vocabulary's pieces
LETTERS = r"[^\p{L}\p{M}]+"
UNIT = 32  # longer words, with their mark, are cut into units of so many characters, which pieces don't cross
ROUNDS = 3
PRIOR = 1000.0  # weight, in pieces, of the piece probabilities of all languages together
LEAST = 1e-9  # lowest probability of a piece, so that a unit's stays above the smallest double
MOST_LANGUAGES = 200  # bounds the probabilities on the driver and in the broadcast
UNDETERMINED = "und"
CELLS = 1 << 22  # values of the forward table worked on at once
SCORE_SLICE = 8 * 2**20
COUNT_SLICE = 32 * 2**20


class Pieces:
    """The lower-case pieces of a vocabulary as a trie, kept in one open-addressed table of (node, character).

    The last piece number, ``unknown``, is that of a character which is no piece by itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [model.IdToPiece(i) for i in range(model.GetPieceSize())
                 if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))]
        self.names = [p for p in every if p == p.lower()]
        self.unknown = len(self.names)
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(self.names):
            node = 0
            for code in map(ord, piece):
                node = children.setdefault((node, code), len(children) + 1)
            ends[node] = number
        self.piece = np.full(len(children) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * len(children)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.array([node << 21 | code for node, code in children], np.int64)
        values = np.fromiter(children.values(), np.int32, len(children))
        self.probes = 0
        while len(keys):
            slot = self._slot(keys, self.probes)
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.nodes[slot[taken]] = keys[taken], values[taken]
            keys, values = np.delete(keys, taken), np.delete(values, taken)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by a character, -1 where there is none."""
        key = node.astype(np.int64) << 21 | code
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for probe in range(self.probes):
            slot = self._slot(key[left], probe)
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = self.nodes[slot[hit]]
            left = left[~hit & (held >= 0)]
            if not len(left):
                break
        return out

    def matches(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, units, pieces): which pieces the units have from start to end, by ascending start.

        ``codes`` has a row a unit, longest units first, 0 after its end. A unit is at most once in a step.
        """
        for start in range(int(lengths.max(initial=0))):
            units = np.arange(np.count_nonzero(lengths > start))
            node = np.zeros(len(units), np.int32)
            for end in range(start + 1, codes.shape[1] + 1):
                node = self.step(node, codes[units, end - 1])
                alive = node >= 0
                piece = np.where(alive, self.piece[node], -1)
                if end == start + 1:
                    alone = np.where(piece < 0, self.unknown, piece)
                    yield start, end, units, alone
                elif (piece >= 0).any():
                    yield start, end, units[piece >= 0], piece[piece >= 0]
                units, node = units[alive], node[alive]
                if not len(units):
                    break


def pieces(path: str) -> Pieces:
    return per_worker(("language pieces", path), lambda: Pieces(path))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different lower-case words (runs of letters and marks), the word of each token, and where texts begin."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), LETTERS)
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends, index = ends - ends[0], coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # before the first and after the last word
        keep = index != blank
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        index = index[keep]
    return coded.dictionary, index, ends


def units_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' units: characters (a row each, 0 after the end), lengths, and the word of each; longest first."""
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
    text = "".join([WORD_START + w for w in words.to_pylist()])
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    count = -(-sizes // UNIT)
    word = np.repeat(np.arange(len(sizes)), count)
    last = np.cumsum(count) - 1
    lengths = np.full(len(word), UNIT)
    lengths[last] = sizes - (count - 1) * UNIT
    codes = np.zeros((len(word), UNIT), np.int64)
    codes[np.arange(UNIT) < lengths[:, None]] = flat
    order = np.argsort(-lengths, kind="stable")
    return codes[order], lengths[order], word[order]


def log_probabilities(known: Pieces, words: pa.Array, table: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language; ``table`` has a row a piece, a column a language."""
    out = np.zeros((len(words), table.shape[1]))
    at_once = max(64, CELLS // ((UNIT + 1) * table.shape[1]))
    for begin in range(0, len(words), at_once):
        codes, lengths, word = units_of(words.slice(begin, at_once))
        ways = np.zeros((len(codes), UNIT + 1, table.shape[1]))
        ways[:, 0] = 1.0
        for start, end, units, piece in known.matches(codes, lengths):
            ways[units, end] += ways[units, start] * table[piece]
        np.add.at(out, begin + word, np.log(ways[np.arange(len(codes)), lengths]))
    return out


def expected_counts(known: Pieces, words: pa.Array, lang: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How often each language is expected to use each piece in ``n`` occurrences of each word of language ``lang``."""
    out = np.zeros(table.size)
    width = table.shape[1]
    flat = table.ravel()
    at_once = CELLS // (4 * UNIT)
    for begin in range(0, len(words), at_once):
        codes, lengths, word = units_of(words.slice(begin, at_once))
        own, weight = lang[begin + word], n[begin + word]
        ahead, behind = np.zeros((len(codes), UNIT + 1)), np.zeros((len(codes), UNIT + 1))
        ahead[:, 0] = 1.0
        steps = []
        for start, end, units, piece in known.matches(codes, lengths):
            cell = piece * width + own[units]
            ahead[units, end] += ahead[units, start] * flat[cell]
            steps.append((start, end, units, cell))
        row = np.arange(len(codes))
        behind[row, lengths] = weight / ahead[row, lengths]
        for start, end, units, cell in reversed(steps):
            used = flat[cell] * behind[units, end]
            behind[units, start] += used
            out += np.bincount(cell, ahead[units, start] * used, len(out))
    return out.reshape(table.shape)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of each language, drawn towards those of all languages by ``PRIOR`` pieces."""
    every = counts.sum(1) + 0.1
    every /= every.sum()
    return np.maximum((counts + PRIOR * every[:, None]) / (counts.sum(0) + PRIOR), LEAST)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text (null: empty) leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class LanguageModel:
    """Piece probabilities (a column a language) and the share of each language among the training documents."""

    def __init__(self, path: str, languages: list[str], shares: np.ndarray, table: np.ndarray):
        self.path, self.languages, self.shares, self.table = path, languages, shares, table

    def posterior(self, texts: pa.Array) -> np.ndarray:
        """Probability of each language for each text; the shares alone where a text has no word."""
        words, index, ends = words_of(texts)
        logs = log_probabilities(pieces(self.path), words, self.table)
        total = np.empty((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            before = np.concatenate([[0.0], np.cumsum(logs[index, j])])
            total[:, j] = np.diff(before[ends])
        total += np.log(self.shares)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n) over all of ``train`` (lang, text): each slice of texts is counted before the shuffle."""
    def run(batches) -> Iterator[dict]:
        for batch in slices(batches, most=COUNT_SLICE):
            words, index, ends = words_of(batch.column(1))
            spoken = batch.column(0).dictionary_encode()
            lang = np.repeat(spoken.indices.to_numpy().astype(np.int64), np.diff(ends))
            cell, n = np.unique(lang * max(1, len(words)) + index, return_counts=True)
            yield {"lang": spoken.dictionary.take(pa.array(cell // max(1, len(words)))),
                   "word": words.take(pa.array(cell % max(1, len(words)))), "n": pa.array(n)}

    return map_rows(train, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, *, rounds: int = ROUNDS, most_languages: int = MOST_LANGUAGES) -> LanguageModel | None:
    """The model of all documents of ``docs`` that have a lang and a text; None if there is none.

    More than ``most_languages`` languages raise: their probabilities would be too many for the driver.
    """
    spark = docs.sparkSession
    known = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).dropna()
    seen = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(seen) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not seen:
        return None
    languages = sorted(r["lang"] for r in seen)
    number = {lang: j for j, lang in enumerate(languages)}
    documents = {r["lang"]: r["count"] for r in seen}
    shares = np.array([documents[lang] for lang in languages], float)
    counts = written(word_counts(known), "lang-words")
    size = Pieces(path).unknown + 1
    table = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(table)

        def run(batches, shared=shared) -> Iterator[dict]:
            sums = np.zeros(shared.value.shape)
            for batch in batches:
                coded = batch.column(0).dictionary_encode()
                own = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                sums += expected_counts(pieces(path), batch.column(1), own, batch.column(2).to_numpy().astype(float),
                                        shared.value)
            piece, lang = np.nonzero(sums)
            yield {"piece": pa.array(piece), "lang": pa.array(lang), "n": pa.array(sums[piece, lang])}

        found = map_rows(counts, run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        sums = np.zeros(table.shape)
        rows = found.toArrow()  # at most one row a piece and language
        sums[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        table = smoothed(sums)
    return LanguageModel(path, languages, shares / shares.sum(), table)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, from its text alone.

    ``score`` is the probability of the predicted language among the learnt ones. A text that is null or has
    no letter, and every text where nothing was learnt, is ``und`` with score 0. Ties go to the language that
    sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[dict]:
        model = shared.value
        for batch in slices(batches, most=SCORE_SLICE):
            texts = pc.fill_null(batch.column(1), "")
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            spoken = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if model is not None and spoken.any():
                posterior = model.posterior(texts.filter(pa.array(spoken)))
                best = posterior.argmax(1)
                lang[spoken] = np.array(model.languages, object)[best]
                score[spoken] = posterior[np.arange(len(best)), best]
            yield {"doc_id": batch.column(0), "lang_pred": lang.tolist(), "score": pa.array(score)}

    asked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = map_rows(asked, run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def learn_and_identify(docs: DataFrame, path: str) -> DataFrame:
    """``identify`` for all of ``docs`` with the model of those that are not held out.

    Rows count once each, so repeated rows are learnt from repeatedly; a null doc_id is the empty text for the
    fold; rows with a null lang or text teach nothing. Other columns are ignored. No rows give no rows.
    """
    return identify(docs, train(docs.where(~held_out(docs["doc_id"])), path))
