"""Removal of runs of lines that occurred before, found by winnowing over line hashes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.llm.batches import document_hash, fresh, map_rows, slices, written

GRAM_WORDS = 8
WINDOW_WORDS = 8


def selected(words: list[int], hashes: list[int], gram_words: int, window_words: int) -> list[tuple[int, int, int]]:
    """Fingerprints (start, end, hash) of a sequence of lines: minima of its windows.

    A gram is the fewest lines from a start on that hold ``gram_words`` words. A window is the fewest
    grams in a row whose first lines hold ``window_words``; its least hash is selected, the last one
    of equal ones. Both depend on the lines in them alone, so a run of lines that holds a whole window
    with its grams selects the same fingerprint wherever it stands.
    """
    import xxhash

    n = len(words)
    grams: list[tuple[int, int, int]] = []
    end, held = 0, 0
    for start in range(n):
        while held < gram_words and end < n:
            held += words[end]
            end += 1
        if held < gram_words:
            break
        digest = xxhash.xxh64_intdigest(b"".join([h.to_bytes(8, "little") for h in hashes[start:end]]), 1)
        grams.append((start, end, digest))
        held -= words[start]
    out, last = [], -1
    for first in range(len(grams)):
        held, at, best = 0, first, first
        while at < len(grams):
            if grams[at][2] <= grams[best][2]:
                best = at
            held += words[at]
            at += 1
            if held >= window_words:
                break
        if best > last:
            out.append(grams[best])
            last = best
        if at == len(grams) and held < window_words:
            break
    return out


def marks(text: str, gram_words: int, window_words: int) -> Iterator[tuple[int, int, int]]:
    """(key, first line, last line) of everything in a text that may be a later copy.

    A key stands for a fingerprint, or for a fingerprint and all lines from it to a line right or left of
    it. Lines are numbered over all of the text's; blank ones have no part in runs.

    A run shared with another text goes on to the right of its last shared fingerprint only while the
    window from the line after the fingerprint's first one, with its grams, isn't whole in it, or that
    window would give a later shared one. To the left of the first shared fingerprint it has less than a
    window's words. So far a fingerprint's lines reach, whatever other fingerprints this text has there:
    those that straddle the run's border are not the other text's.
    """
    import xxhash

    places, words, hashes = [], [], []
    for place, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            places.append(place)
            words.append(n)
            hashes.append(xxhash.xxh64_intdigest(line.strip(), 0))
    prints = selected(words, hashes, gram_words, window_words)
    total = [0, *accumulate(words)]
    for start, end, digest in prints:
        yield digest, places[start], places[end - 1]
        last = bisect_left(total, total[start + 1] + window_words) - 1  # the window's last gram begins there
        stop = bisect_left(total, total[last] + gram_words) - 1 if last < len(words) else len(words)
        least = bisect_right(total, total[start] - window_words)
        for seed, reach in ((2, range(end, stop)), (3, range(start - 1, least - 1, -1))):
            chain = digest
            for at in reach:
                chain = xxhash.xxh64_intdigest(chain.to_bytes(8, "little") + hashes[at].to_bytes(8, "little"), seed)
                yield chain, places[at], places[at]


def repeated_lines(docs: DataFrame, *, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed): the numbers, from 0, of each document's lines that repeat an earlier run.

    Earlier means a smaller doc_id, then text hash, then line number; null ids come first. Every key of
    ``marks`` is joined with its first occurrence alone, which aggregation finds without gathering a
    key's occurrences: lines up to any earlier copy's end have keys that this copy has too, so a run is
    found as far as the longest earlier copy reaches. Documents without such lines give no row. Rows
    with the same doc_id and text count as one document.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                      F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
                      document_hash(docs["text"]).alias("text_hash"))

    def run(batches):
        for batch in slices(batches):
            out: dict[str, list] = {"key": [], "doc_id": [], "text_hash": [], "a": [], "b": []}
            for doc, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, a, b in marks(text, gram_words, window_words):
                    for name, value in zip(out, (key - 2**63, doc, digest, a, b), strict=True):
                        out[name].append(value)
            yield {name: pa.array(values) if values else values for name, values in out.items()} if out["key"] else out

    found = written(map_rows(own, run, "key long, doc_id long, text_hash long, a long, b long"), "line-keys")
    place = F.struct("doc_id", "text_hash", "a")
    first = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    first = written(first, "first-lines")  # a join of two tables, so that adaptive execution can cut a common key's rows
    later = found.join(first.select("key", "first"), "key").where(place != F.col("first"))
    lines = later.select("doc_id", "text_hash", F.explode(F.sequence("a", "b")).alias("line"))
    return lines.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    def cut(value, lines):
        if value is None or lines is None:
            return value
        gone = set(lines)
        return "\n".join([line for i, line in enumerate(value.split("\n")) if i not in gone])

    return pd.Series([cut(t, r) for t, r in zip(text, removed, strict=True)], dtype=object)


def deduplicated(docs: DataFrame, *, removed: str | None = None, gram_words: int = GRAM_WORDS,
                 window_words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without lines that repeat an earlier run of lines; n_chars is counted anew where lines go.

    A run of at least ``gram_words + window_words`` words in whole lines is always found, a shorter one
    if it holds a fingerprint. All rows stay, and texts that lose nothing stay as they are, null ones
    too; a text may become empty. ``removed`` names a column for the numbers of the lost lines.
    """
    key, gone = fresh(docs, "_text_hash"), removed or fresh(docs, "_removed")
    doc, text_hash = fresh(docs, "_id"), fresh(docs, "_hash")
    lost = repeated_lines(docs, gram_words=gram_words, window_words=window_words).select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("removed").alias(gone))
    marked = docs.withColumn(key, document_hash(docs["text"]))
    both = marked.join(
        lost, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash)), "left")
    out = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        _without(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone))))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns, *([gone] if removed else []))
