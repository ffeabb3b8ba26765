"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The field's potentials come from features of the line and its neighbours and
from the labels of lines in a row; forward-backward gives each line's probability to be good. Their
mean, weighted by line lengths, is a document's quality, put on a probability scale by a logistic fit.
Lines have no labels of their own: those of a training document take the document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import document_hash, map_rows, slices, texts, written

BYTES_PER_STEP = 2**20  # of text that is scored at once: bounds the arrays a worker holds
TRAINING_ROWS = 2000  # of each label: bounds what the driver gets to fit the field
TRAINING_LINES = 150_000  # of each label: bounds the arrays of the fit; a text goes in whole or not at all
STEPS = 120
PENALTY = 1e-3
FEATURES = ("log words", "word length", "capitals", "digits", "symbols", "exclamations", "bars", "stops", "other bytes",
            "word again", "different words", "line again")

# Byte classes.
_CLASSES = {"capitals": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&|<>", "exclamations": b"!",
            "bars": b"|", "stops": b".,", "other bytes": range(128, 256)}
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (null: empty), modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def line_features(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths in bytes, and where each text's lines begin.

    All from whole texts, without a loop over lines. A text without words has no lines.
    """
    batch = pc.cast(batch, pa.large_string())
    ends = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset:batch.offset + len(batch) + 1]
    data = np.frombuffer(batch.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(batch) else np.zeros(0, np.uint8)
    docs = ends - ends[0]
    white = _WHITE[data]
    begins = ~white
    begins[1:] &= white[:-1]
    heads = docs[:-1][docs[:-1] < docs[1:]]
    begins[heads] = ~white[heads]  # a word never goes on from one text to the next
    word_at = np.flatnonzero(begins)
    line_at = np.union1d(heads, np.flatnonzero(data == 10) + 1)
    line_at = line_at[line_at < len(data)]
    word_line = np.searchsorted(line_at, word_at, "right") - 1
    words = np.bincount(word_line, minlength=len(line_at))
    keep = words > 0
    number = np.cumsum(keep) - 1
    word_line, words, start = number[word_line], words[keep], line_at[keep]
    end = np.append(line_at[1:], len(data))[keep] if len(line_at) else start
    n = len(start)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(len(docs), np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[end] - total[start]).astype(np.int64)

    size = np.maximum(count(~white), 1)
    share = {name: count(np.isin(data, list(values))) / size for name, values in _CLASSES.items()}
    # The same bytes give the same code: texts' words in order, as the byte scan found them.
    coded = _words(batch).dictionary_encode().indices.to_numpy()
    again = np.zeros(len(coded), bool)
    again[1:] = (coded[1:] == coded[:-1]) & (word_line[1:] == word_line[:-1])
    pairs = np.unique(word_line.astype(np.int64) * (int(coded.max()) + 1) + coded)
    different = np.bincount(pairs // (int(coded.max()) + 1), minlength=n) / words
    doc_of = np.searchsorted(docs, start, "right") - 1
    mixed = (coded.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.arange(len(coded), dtype=np.uint64) - np.searchsorted(word_line, word_line).astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(31)) * (np.uint64(2) * order + np.uint64(1))
    digest = np.add.reduceat(mixed, np.searchsorted(word_line, np.arange(n)))
    ranked = np.lexsort((np.arange(n), digest, doc_of))
    same = np.zeros(n, bool)
    same[ranked[1:]] = (digest[ranked[1:]] == digest[ranked[:-1]]) & (doc_of[ranked[1:]] == doc_of[ranked[:-1]])
    table = [np.log1p(words), size / words / 10, *[share[name] for name in FEATURES[2:9]],
             np.bincount(word_line[again], minlength=n) / words, different, same.astype(float)]
    return np.stack(table, 1), end - start, np.searchsorted(start, docs)


def _words(batch: pa.Array) -> pa.Array:
    """All words of all texts in order."""
    split = pc.ascii_split_whitespace(batch)
    lists = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py())
    return lists.filter(pc.not_equal(lists, ""))


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after (zero at a text's ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = 0
    after[bounds[1:][filled] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1)


def forward_backward(emission: np.ndarray, transition: np.ndarray, bounds: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every line, expected transitions of every text, and its log partition; all texts in step.

    ``emission``: (lines, 2) log potentials; ``transition``: (2, 2), from the line before to the line.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alpha, beta = np.zeros_like(emission), np.zeros_like(emission)
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest + 1)]  # texts with more than t lines
    plus = lambda a, b: np.logaddexp(a, b)
    for t in range(longest):
        at = begin[:live[t]] + t
        alpha[at] = emission[at]
        if t:
            previous = alpha[at - 1]
            for s in (0, 1):
                alpha[at, s] += plus(previous[:, 0] + transition[0, s], previous[:, 1] + transition[1, s])
    for t in reversed(range(longest - 1)):
        at = begin[:live[t + 1]] + t
        later = beta[at + 1] + emission[at + 1]
        for s in (0, 1):
            beta[at, s] = plus(later[:, 0] + transition[s, 0], later[:, 1] + transition[s, 1])
    total = plus(*(alpha + beta).T) if len(alpha) else np.zeros(0)
    marginal = np.exp(alpha + beta - total[:, None])
    first = np.zeros(len(emission), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    at = np.flatnonzero(~first)
    joint = np.exp(alpha[at - 1][:, :, None] + transition[None] + (emission[at] + beta[at])[:, None, :] - total[at][:, None, None])
    return marginal, joint.sum(0) if len(at) else np.zeros((2, 2)), total[first]


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a good line; a bad line has none
    transition: np.ndarray
    slope: float
    shift: float

    def quality(self, own: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities to be good; half for a text without lines."""
        x = with_neighbours((own - self.mean) / self.scale, bounds)
        emission = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        marginal = forward_backward(emission, self.transition, bounds)[0][:, 1]
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
        weight = total(sizes)
        return np.where(weight > 0, total(marginal * sizes) / np.maximum(weight, 1), 0.5)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.shift, -40, 40)))


def fit(own: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, good: np.ndarray, weight: np.ndarray,
        steps: int = STEPS, penalty: float = PENALTY) -> LineField:
    """Weights by gradient ascent on the labels' likelihood, each line labelled as its text."""
    mean, scale = own.mean(0) if len(own) else np.zeros(len(FEATURES)), own.std(0) + 1e-3 if len(own) else np.ones(len(FEATURES))
    x = with_neighbours((own - mean) / scale, bounds)
    label = np.repeat(good, np.diff(bounds)).astype(float)
    inner = np.ones(len(x), bool)
    inner[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner].astype(int), label[inner].astype(int)), 1)
    n = max(1, len(x))
    value = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        transition = value[-4:].reshape(2, 2)
        emission = np.stack([np.zeros(len(x)), x @ value[:-4]], 1)
        marginal, joint, _ = forward_backward(emission, transition, bounds)
        slope = np.concatenate([x.T @ (label - marginal[:, 1]), (seen - joint).ravel()]) / n - penalty * value
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        value = value + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    field = LineField(mean, scale, value[:-4], value[-4:].reshape(2, 2), 1.0, 0.0)
    quality = field.quality(own, sizes, bounds)
    # Logistic fit of the label on the quality, each label with its weight among all labelled rows.
    a, b = 0.0, 0.0
    z = np.stack([quality, np.ones(len(quality))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ [a, b], -40, 40)))
        slope = z.T @ (weight * (good - p)) - 1e-3 * np.array([a, b])
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) + np.linalg.solve(curve, slope)
    field.slope, field.shift = float(a), float(b)
    return field


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, n, own, sizes): number, features and lengths of each text's lines."""
    def run(batches):
        for batch in slices(batches):
            own, sizes, bounds = line_features(batch.column(1))
            spans = list(zip(bounds, bounds[1:], strict=False))
            yield {"doc_id": batch.column(0), "n": [b - a for a, b in spans],
                   "own": [own[a:b].astype("<f8").tobytes() for a, b in spans],
                   "sizes": [sizes[a:b].astype("<i8").tobytes() for a, b in spans]}

    return map_rows(texts(docs), run, "doc_id long, n long, own binary, sizes binary")


def whole_texts(sizes: list[tuple[int, int]], lines: int) -> list[int]:
    """The ids of (doc_id, lines), in the given order, whose lines have room below ``lines`` together.

    A text that has no room is left out and the next ones are tried, so one very long text takes no room from others.
    """
    out, held = [], 0
    for doc_id, n in sizes:
        if held + n <= lines:
            out.append(doc_id)
            held += n
    return out


def train(docs: DataFrame, labels: DataFrame, training: Column, *, rows: int = TRAINING_ROWS, lines: int = TRAINING_LINES,
          steps: int = STEPS) -> LineField | float:
    """A field fitted on labelled documents for whose doc_id ``training`` holds.

    At most ``rows`` ids of each label are fitted, those with the smallest hash of their id, each with one
    whole text, that with the smallest hash, as long as they have at most ``lines`` lines together; the labels'
    shares come from all ids. Returns a constant score where only one label, or none, is there: that label, or 1/2. Labels other than 0 and 1 are left out, of several for one id the largest holds.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good")).where(training)
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    chosen = [known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for g in (0, 1)]
    sample = {r["doc_id"]: r["good"] for part in chosen for r in part.collect()}  # at most twice ``rows`` ids
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sample], "_wanted long"))
    own = texts(docs)
    kept = own.join(wanted, own["doc_id"] == wanted["_wanted"], "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(document_hash(F.col("text")).alias("h"), "text")).alias("least"))
    measured = written(_features(kept.select("doc_id", "least.text")), "line-features")
    sizes = measured.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "n").collect()  # at most twice ``rows``
    fitted = [i for g in (0, 1) for i in whole_texts([(i, n) for i, n in sizes if sample[i] == g], lines)]
    found = measured.where(F.col("doc_id").isin(fitted)).collect()
    found.sort(key=lambda r: (r["doc_id"], r["own"]))
    assert sum(r["n"] for r in found) <= 2 * lines
    own = np.concatenate([np.frombuffer(r["own"], "<f8").reshape(-1, len(FEATURES)) for r in found] or [np.zeros((0, len(FEATURES)))])
    sizes = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in found] or [np.zeros(0, np.int64)])
    bounds = np.cumsum([0, *(len(r["sizes"]) // 8 for r in found)])
    good = np.array([sample[r["doc_id"]] for r in found], float)
    if len(set(good.tolist())) < 2:
        return float(good[0]) if len(good) else 0.5
    each = {g: counts[g] / max(1, int((good == g).sum())) for g in (0, 1)}
    weight = np.where(good == 1, each[1], each[0])
    return fit(own, sizes, bounds, good, weight / weight.mean(), steps)


def _scores(batch: pa.Array, model: LineField | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(batch), model)
    return model.score(model.quality(*line_features(batch)))


def score(docs: DataFrame, model: LineField | float) -> DataFrame:
    """(doc_id, score) of every row, null and empty texts (which have no lines) too."""
    def run(batches):
        for batch in slices(batches, most=BYTES_PER_STEP):
            yield {"doc_id": batch.column(0), "score": pa.array(_scores(batch.column(1), model), pa.float64())}

    return map_rows(texts(docs), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; learnt outside fold ``held_out``.

    Nothing but texts goes into a score. A null text is empty; empty texts get the score of half the
    quality. Repeated rows give rows each, a null doc_id has the fold of the empty text. No rows give no rows.
    """
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held_out)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: LineField | float, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pc.fill_null(text.cast(pa.string()), "")], names=["text"])
        parts = [_scores(part.column(0), model) for part in slices([batch], 0, BYTES_PER_STEP)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.where(scored(F.col("text").cast("string")) >= least)
