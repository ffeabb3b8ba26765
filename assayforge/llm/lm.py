"""Language-model scores from a log-frequency Bloom filter of word counts and word-pair counts.

A gram is the 64-bit hash of a word (lowest bit 0) or of two words in a row (lowest bit 1). Its count n
is quantised to level 1 + floor(log n / log BASE). The filter holds (gram, level) for every level from
the lowest kept one up to the gram's own, so a gram's level is found by asking for one level after the
other until one is missing; a false positive can only raise a level.

``score`` cuts the corpus into slices of texts that are written once. Each slice sends its different grams, packed, to
bands of grams, together as what it adds to their counts and as a question. A band adds up, makes the segments of the filter that
hold its grams, asks them and answers each slice, which then scores its texts. So the filter is never in one place,
and a gram of a slice crosses the network once, its answer once. ``build_filter`` makes the filter in one piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import map_rows, slices, texts, written

BASE = 1.5
LOWEST_LEVEL = 2  # counts from 2 on; level 1, grams seen once, is four fifths of the pairs and mostly tells copies
SEGMENT_BITS = 1 << 16
MOST_SEGMENTS = 6 << 10  # bounds a filter in one piece: 48 MiB
BITS_PER_ENTRY = 12
PROBES = 5
COUNT_SLICE = 32 * 2**20
SCORE_SLICE = 8 * 2**20
BAND_GRAMS = 1 << 20  # about as many grams of slices meet in a band, which one task holds
GRAM_BYTES = 8  # of text for each gram of a slice, as measured
ASKED = 1 << 40  # above all counts: what a slice that only asks for a pair adds to its count
MASS = 30.0  # weight of the word's own probability in that of a pair
UNSEEN = 0.5  # count of a word that the filter lacks: seen once or not at all

_U64 = np.uint64
_ONE = _U64(1)
END = _U64(0x5851F42D4C957F2C)  # fixed gram of the end of a text
START = _U64(0x14057B7EF767814E)  # stands before the first word


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (null: empty) in fold 0 of ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_grams(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram of each different word, the word number of each token, and where texts begin.

    A-Z are lower-cased, words end at ASCII white space, and every text has one end token more.
    """
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(batch)))
    places = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(places[0], places[-1] - places[0]).dictionary_encode()
    places = places - places[0]
    words = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    grams = np.array([digest(w) for w in words] + [int(END)], _U64) & ~_ONE
    index = coded.indices.to_numpy()
    if "" in words:  # an empty text splits into one empty word
        keep = index != words.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        index, places = index[keep], before[places]
    index = np.insert(index, places[1:], len(words))
    return grams, index, places + np.arange(len(places))


def pair_grams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gram of each token with the token before it, START before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    x = (before * _U64(0x9E3779B97F4A7C15)) ^ (tokens + (before >> _U64(32)))
    x = (x ^ x >> _U64(29)) * _U64(0xBF58476D1CE4E5B9)
    return x ^ x >> _U64(32) | _ONE


def gram_counts(docs: DataFrame, lowest: int = LOWEST_LEVEL, asked: DataFrame | None = None) -> DataFrame:
    """(gram, n) over all of ``docs``: every word, and the pairs of level ``lowest``, 1 or 2, and above.

    Each slice of texts is counted before anything is shuffled; the sums are Spark's. Where ``asked`` gives the only
    other texts that will ask for a count, a pair that ``docs`` have once is kept if one of those has it too: in the
    text of ``docs`` that has it, it is known to be there.
    """
    def ask(batches):
        for batch in slices(batches, most=COUNT_SLICE):
            grams, index, starts = word_grams(batch.column(1))
            pairs = np.unique(pair_grams(grams[index], starts[:-1]))
            yield {"gram": pa.array(pairs.view(np.int64)), "n": pa.array(np.full(len(pairs), ASKED))}

    def run(batches):
        for batch in slices(batches, most=COUNT_SLICE):
            grams, index, starts = word_grams(batch.column(1))
            pairs, n = np.unique(pair_grams(grams[index], starts[:-1]), return_counts=True)
            words = np.bincount(index, minlength=len(grams))
            yield {"gram": pa.array(np.concatenate([grams, pairs]).view(np.int64)),
                   "n": pa.array(np.concatenate([words, n]))}

    rows = map_rows(texts(docs), run, "gram long, n long")
    if asked is not None:
        rows = rows.unionAll(map_rows(texts(asked), ask, "gram long, n long"))
    sums = rows.groupBy("gram").agg(F.sum("n").alias("sum"))
    counts = sums.select("gram", F.col("sum").bitwiseAND(ASKED - 1).alias("n"), (F.col("sum") >= ASKED).alias("asked"))
    wanted = F.col("n") >= lowest
    if asked is not None:
        wanted = wanted & ((F.col("n") > 1) | F.col("asked"))
    return counts.where((F.col("gram").bitwiseAND(1) == 0) & (F.col("n") > 0) | wanted).select("gram", "n")


@dataclass
class LogFrequencyFilter:
    bits: np.ndarray  # uint32 words, SEGMENT_BITS bits a segment
    segments: int
    lowest: int
    highest: int

    def _places(self, grams: np.ndarray, level: int, probe: int) -> np.ndarray:
        return _segment(grams, self.segments) * SEGMENT_BITS + _bit(grams, level, probe)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each gram, 0 where the filter lacks it."""
        out = np.zeros(len(grams), np.int64)
        left = np.arange(len(grams))
        for level in range(self.lowest, self.highest + 1):
            for probe in range(PROBES):
                at = self._places(grams[left], level, probe)
                left = left[self.bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) == 1]
                if not len(left):
                    return out
            out[left] = level
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Middle of each gram's level, 0 where the filter lacks it."""
        middle = [0.0] * self.lowest + [expected_count(j) for j in range(self.lowest, self.highest + 1)]
        return np.array(middle)[self.levels(grams)]


def expected_count(level: int) -> float:
    low, high = math.ceil(BASE ** (level - 1) - 1e-9), math.ceil(BASE**level - 1e-9) - 1
    return math.sqrt(low * max(low, high))


def _segment(grams: np.ndarray, segments: int) -> np.ndarray:
    return (grams >> _ONE).astype(np.int64) % segments


def _bit(grams: np.ndarray, level: int, probe: int) -> np.ndarray:
    x = (grams + _U64((level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F) % 2**64)) * _U64(0xD6E8FEB86659FD93)
    return ((x ^ x >> _U64(32)) * _U64(0xD6E8FEB86659FD93) >> _U64(48)).astype(np.int64) % SEGMENT_BITS


def _level(n: Column) -> Column:
    return F.floor(F.log(n + 1e-9) / math.log(BASE)).cast("int") + 1


@dataclass
class RareGrams:
    """What lies below the levels of a filter in one piece."""

    pairs: DataFrame  # (gram, level)
    lowest: int
    segments: int


def _marks(gram: np.ndarray, level: np.ndarray, lowest: int, segments: int = 1) -> np.ndarray:
    """The bits that the entries of grams set in their segments, a byte each."""
    out = np.zeros(segments * SEGMENT_BITS, np.uint8)
    for j in range(lowest, int(level.max(initial=0)) + 1):
        own = gram[level >= j]
        first = _segment(own, segments) * SEGMENT_BITS
        for probe in range(PROBES):
            out[first + _bit(own, j, probe)] = 1
    return out


def _segments(have: dict[int, int], lowest: int) -> int:
    """How many segments the entries of ``have``, grams by level, need from level ``lowest`` on."""
    entries = sum(n * (level - lowest + 1) for level, n in have.items() if level >= lowest)
    return max(1, math.ceil(entries * BITS_PER_ENTRY / SEGMENT_BITS))


def _lowest(have: dict[int, int], least: int, most_segments: int) -> int:
    """The lowest level, from ``least`` on, from which ``most_segments`` have room for the entries."""
    lowest = least
    while _segments(have, lowest) > most_segments:
        lowest += 1
    return lowest


def build_filter(counts: DataFrame, most_segments: int = MOST_SEGMENTS, least: int = LOWEST_LEVEL
                 ) -> tuple[LogFrequencyFilter, RareGrams | None]:
    """The filter of counts (gram, n) in one piece, and what it has no room for.

    The number of segments follows that of entries, at ``BITS_PER_ENTRY``. Where there would be more than
    ``most_segments``, the filter begins at a higher level; the pairs below it are ``RareGrams``, with the segments that
    they would need. The histogram of levels that decides it covers all grams. A segment's
    bits are made in one task from its own grams, and the driver gets one bit field a segment.
    """
    graded = counts.where(F.col("n") >= least).withColumn("level", _level(F.col("n")))
    is_word = F.col("gram").bitwiseAND(1) == 0
    seen = graded.groupBy("level", is_word.alias("word")).agg(F.count("*").alias("grams")).collect()
    have: dict[int, int] = {}
    for r in seen:
        have[r["level"]] = have.get(r["level"], 0) + r["grams"]
    highest, lowest = max(have, default=least), _lowest(have, least, most_segments)
    segments = _segments(have, lowest)
    rare = None
    if lowest > least:
        below = [r for r in seen if r["level"] < lowest]
        size = sum(r["grams"] * (r["level"] - least + 1) for r in below if not r["word"])
        rare = RareGrams(graded.where(~is_word & (F.col("level") < lowest)).select("gram", "level"), least,
                         max(1, math.ceil(size * BITS_PER_ENTRY / SEGMENT_BITS)))

    def run(batches) -> Iterator[dict]:
        at, field = None, None
        for batch in batches:
            segment, gram, level = (c.to_numpy() for c in batch.columns)
            gram = gram.view(_U64)
            for own in np.unique(segment).tolist():
                if own != at:
                    if at is not None:
                        yield {"segment": [at], "bits": [field.tobytes()]}
                    at, field = own, np.zeros(SEGMENT_BITS // 8, np.uint8)
                here = segment == own
                field |= np.packbits(_marks(gram[here], level[here], lowest), bitorder="little")
        if at is not None:
            yield {"segment": [at], "bits": [field.tobytes()]}

    placed = graded.where(F.col("level") >= lowest).select(
        (F.shiftrightunsigned("gram", 1) % segments).cast("int").alias("segment"), "gram", "level")
    fields = map_rows(placed.repartition("segment").sortWithinPartitions("segment"), run, "segment int, bits binary")
    bits = np.zeros((segments, SEGMENT_BITS // 32), "<u4")
    for row in fields.collect():  # at most MOST_SEGMENTS rows of 8 KiB
        bits[row["segment"]] |= np.frombuffer(row["bits"], "<u4")
    return LogFrequencyFilter(bits.ravel(), segments, lowest, highest), rare


def pair_log(pair: np.ndarray, alone: np.ndarray, before: np.ndarray, mass: float) -> np.ndarray:
    """log10 of the smoothed probability of a word with probability ``alone`` after one with count ``before``."""
    return np.log10((pair + mass * alone) / (np.maximum(before, pair) + mass))


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The integers between each two ``cuts`` as bytes, first all lowest ones: high bytes are alike and compress away."""
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width)
    return pa.array([planes[a:b].T.tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _unpacked(packed: list, kind: type) -> np.ndarray:
    """The integers of ``_packed`` bytes, in a row."""
    width = np.dtype(kind).itemsize
    planes = [np.frombuffer(x, np.uint8).reshape(width, -1) for x in packed]
    if not planes:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(kind).ravel()


def sliced(docs: DataFrame, folds: int) -> DataFrame:
    """(slice, size, learnt, rows): the texts in slices of about ``SCORE_SLICE`` bytes, written out so that they stay.

    ``rows`` are compressed Arrow rows (doc_id, text, learnt), ``learnt`` counts those outside fold 0, ``size`` is of the texts.
    """
    def run(batches) -> Iterator[dict]:
        for batch in slices(batches, most=SCORE_SLICE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield {"size": [pc.sum(pc.binary_length(batch.column(1))).as_py()], "learnt": [pc.sum(batch.column(2)).as_py()],
                   "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())}

    marked = texts(docs, (~held_out(docs["doc_id"], folds)).alias("learnt"))
    rows = map_rows(marked, run, "size long, learnt long, rows binary")
    return written(rows.withColumn("slice", F.monotonically_increasing_id()), "slices")


@dataclass
class SliceGrams:
    """The texts of a slice as grams: sorted words and pairs, and which of them each token is."""

    doc_id: pa.Array
    learnt: np.ndarray
    starts: np.ndarray  # where texts begin among the tokens, and their end
    words: np.ndarray
    word_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray

    @classmethod
    def of(cls, rows: pa.Scalar) -> SliceGrams:
        batch = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
        grams, index, starts = word_grams(batch.column(1))
        words, at = np.unique(grams, return_inverse=True)
        pairs, pair_at = np.unique(pair_grams(grams[index], starts[:-1]), return_inverse=True)
        return cls(batch.column(0), batch.column(2).to_numpy(zero_copy_only=False), starts, words, at[index], pairs, pair_at)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """All grams, sorted, and where each of the words and then the pairs comes from."""
        both = np.concatenate([self.words, self.pairs])
        order = np.argsort(both)
        return both[order], order


def slice_grams(rows: DataFrame, bands: int) -> DataFrame:
    """(slice, band, grams, adds): of each slice its different grams by their highest bits, packed.

    ``adds`` is twice the count in the texts that are learnt from, odd where a text that is not asks for the gram.
    """
    shift = _U64(64 - bands.bit_length() + 1)

    def run(batches) -> Iterator[dict]:
        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = SliceGrams.of(one)
                learnt = np.repeat(own.learnt, np.diff(own.starts))
                adds = []
                for grams, at in ((own.words, own.word_at), (own.pairs, own.pair_at)):
                    asked = np.zeros(len(grams), np.uint32)
                    asked[at[~learnt]] = 1
                    adds.append(2 * np.bincount(at[learnt], minlength=len(grams)).astype(np.uint32) + asked)
                grams, order = own.order()
                band = (grams >> shift).astype(np.int64) if bands > 1 else np.zeros(len(grams), np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(band)) + 1, len(grams)]
                yield {"slice": pa.array(np.full(len(cuts) - 1, name)), "band": pa.array(band[cuts[:-1]].astype(np.int32)),
                       "grams": _packed(grams, cuts), "adds": _packed(np.concatenate(adds)[order], cuts)}

    return map_rows(rows.select("slice", "rows"), run, "slice long, band int, grams binary, adds binary")


def _answer(names: list, grams: list, adds: list, least: int) -> tuple[dict, dict]:
    """What one band answers to its slices, and what its grams are: the histogram of levels, tokens and different words."""
    sizes = [len(x) // 8 for x in grams]
    gram, at = np.unique(_unpacked(grams, _U64), return_inverse=True)
    add = _unpacked(adds, np.uint32)
    n = np.bincount(at, add >> 1, len(gram)).astype(np.int64)
    asked = np.bincount(at, add & 1, len(gram)) > 0
    is_word = gram & _ONE == 0
    kept = np.flatnonzero((n >= least) & (is_word | (n > 1) | asked))
    level = np.floor(np.log(n[kept] + 1e-9) / math.log(BASE)).astype(np.int64) + 1
    have = np.bincount(level)
    segments = _segments(dict(enumerate(have.tolist())), least)
    bits = np.packbits(_marks(gram[kept], level, least, segments), bitorder="little").view("<u4")
    found = LogFrequencyFilter(bits, segments, least, int(level.max(initial=least))).levels(gram).astype(np.uint8)[at]
    cuts = np.r_[0, np.cumsum(sizes)]
    word = is_word[at]
    word_cuts = np.r_[0, np.cumsum(word)][cuts]
    total = n[is_word]
    return ({"slice": pa.array(names), "levels": _packed(found, cuts), "counts": _packed(n[at][word], word_cuts)},
            {"have": [have.tolist()], "tokens": [int(total.sum())], "words": [int((total > 0).sum())]})


def band_answers(asked: DataFrame, least: int) -> DataFrame:
    """(slice, band, levels, counts) for each row of ``slice_grams``, and a row (have, tokens, words) without slice a band.

    ``levels`` come from the band's own segments of the filter, ``counts`` of its words are exact. A pair that training
    has once is stored if a text that is not learnt from asks for it.
    """
    schema = "slice long, band int, levels binary, counts binary, have array<long>, tokens long, words long"

    def run(batches) -> Iterator[dict]:
        def done() -> Iterator[dict]:
            to_slices, own = _answer(*(sum(x, []) for x in zip(*kept, strict=True)), least)
            n = len(to_slices["slice"])
            blank = lambda kind, size: pa.nulls(size, kind)
            yield to_slices | {"band": pa.array(np.full(n, at, np.int32)), "have": blank(pa.list_(pa.int64()), n),
                               "tokens": blank(pa.int64(), n), "words": blank(pa.int64(), n)}
            yield own | {"slice": blank(pa.int64(), 1), "band": [at], "levels": blank(pa.binary(), 1), "counts": blank(pa.binary(), 1)}

        at, kept = None, []
        for batch in batches:
            band = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if band[a] != at and kept:
                    yield from done()
                    kept = []
                at = int(band[a])
                kept.append([batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2, 3)])
        if kept:
            yield from done()

    placed = asked.select("band", "slice", "grams", "adds").repartition("band").sortWithinPartitions("band")
    return written(map_rows(placed, run, schema), "answers")


def pair_log(pair: np.ndarray, alone: np.ndarray, before: np.ndarray, mass: float) -> np.ndarray:
    """log10 of the smoothed probability of a word with probability ``alone`` after one with count ``before``."""
    return np.log10((pair + mass * alone) / (np.maximum(before, pair) + mass))


def score(docs: DataFrame, *, folds: int = 10, mass: float = MASS, most_segments: int = MOST_SEGMENTS,
          lowest: int = LOWEST_LEVEL) -> DataFrame:
    """Scores of every row of ``docs``, learnt from those outside fold 0.

    Columns: doc_id, held_out (fold 0), n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (exact smoothed word log10 probability), score (log10
    probability by the filter's pairs: (c(uw) + mass P(w)) / (c(u) + mass)).

    Word counts in ``score`` are the filter's too, of all levels if ``most_segments`` have room for it, else from the
    level on that they have room for; rarer words then have their exact counts. No pair is left out at any size.

    ``lowest``: 2 leaves out grams that training has once, 1 keeps them. A text that was learnt from has each of its pairs
    at least once, so that of the pairs seen once only those are stored that a held-out text has too: no other is asked for.

    Word counts behind base_score are exact. A null text is empty and has the end token alone; a
    null doc_id counts as the empty text for the fold; repeated rows are learnt and scored each. With
    nothing to learn from, every token has count 0. No rows give no rows.
    """
    rows = sliced(docs, folds)
    size, n_docs = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0))).first()
    bands = 1 << max(0, math.ceil(math.log2(max(1, size) / GRAM_BYTES / BAND_GRAMS)))  # grams are hashes: bands are even
    answers = band_answers(slice_grams(rows, bands), lowest)
    of_bands = answers.where(F.col("slice").isNull())
    total, distinct = of_bands.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    levels = of_bands.select(F.posexplode("have").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    filtered = _lowest({r["level"]: r["n"] for r in levels}, lowest, most_segments)
    scale = total + 0.1 * (distinct + 1)
    highest = max((r["level"] for r in levels), default=lowest)
    middle = np.array([0.0] * lowest + [expected_count(j) for j in range(lowest, highest + 1)])

    def scored(own: SliceGrams, level: np.ndarray, exact: np.ndarray) -> dict:
        found = np.empty_like(level)
        found[own.order()[1]] = level
        word, pair = found[: len(own.words)], middle[found[len(own.words):]]
        count = middle[word] if filtered == lowest else np.where(word >= filtered, middle[word], exact)
        alone = ((np.maximum(count, UNSEEN) + 0.1) / scale)[own.word_at]
        first, tokens = own.starts[:-1], np.diff(own.starts)
        before = np.empty(len(own.word_at))
        before[1:] = count[own.word_at[:-1]]
        before[first] = float(n_docs)  # START stands before one pair in each training text
        least = np.repeat(own.learnt & (lowest == 1), tokens).astype(float)
        logs = pair_log(np.maximum(pair[own.pair_at], least), alone, before, mass)
        return {"doc_id": own.doc_id, "n_tokens": pa.array(tokens),
                "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64)[own.word_at], first)),
                "base_score": pa.array(np.add.reduceat(np.log10((exact + 0.1) / scale)[own.word_at], first)),
                "score": pa.array(np.add.reduceat(logs, first))}

    def run(batches) -> Iterator[dict]:
        level, exact = [], []
        for batch in batches:
            whole, levels, counts = (batch.column(i) for i in (1, 2, 3))
            for i in range(batch.num_rows):  # the answers of all bands, then the slice
                if whole[i].is_valid:
                    yield scored(SliceGrams.of(whole[i]), _unpacked(level, np.uint8), _unpacked(exact, np.int64))
                    level, exact = [], []
                else:
                    level.append(levels[i].as_py())
                    exact.append(counts[i].as_py())

    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = answers.where(F.col("slice").isNotNull()).select("slice", "band", blank("binary", "rows"), "levels", "counts").unionByName(
        rows.select("slice", F.lit(bands).alias("band"), "rows", blank("binary", "levels"), blank("binary", "counts")))
    both = both.repartition("slice").sortWithinPartitions("slice", "band").select("slice", "rows", "levels", "counts")
    found = map_rows(both, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens", "n_known",
                        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
