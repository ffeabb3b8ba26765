"""Quality rules whose cutoffs are chosen under a limit on false rejections, in DataFrame functions alone.

A document has a share of symbols, capitals, repeated lines and repeated words. The rules of a stratum (a band
of document lengths) reject it if any share is above the stratum's cutoff, so what is certified is what all of
them reject together: by the exact binomial test, at a level divided by the number of strata, no more than
``risk`` of the stratum's good documents. Cutoffs of a stratum are tested from the most lenient one on, each only
if those before it passed, which takes no further correction. Labelled documents decide, each text once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.batches import document_hash, written

WHITE = " \t\n\x0b\f\r"
_RUNS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
BANDS = (20, 100, 400, 1600)  # a stratum begins at each of these numbers of words
STEPS = 32  # cutoffs are 1/32 to 31/32
RISK = 0.025  # most good documents of a stratum that its rules may reject: 147 without a rejection certify it
LEVEL = 0.1  # of all strata together
PRICE = 50  # a share of good documents rejected counts so many times one of bad documents
SIGNALS = {  # share: numerator, denominator
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def _with(value: Column, body) -> Column:
    """``body(value)`` with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the window hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = _with(placed, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words) of every row.

    Lines are those with a word. Windows of eight words are compared by 64-bit hashes within a text. A
    null text has no words; repeated rows give rows each. Row-local: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _RUNS))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, WHITE) != "")
    cut = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), document_hash(docs["text"]).alias("text_hash"),
        F.length(_without(text, WHITE)).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), _count(text, CAPITALS).alias("n_capitals"),
        words.alias("words"), lines.alias("lines"))
    hashed = cut.select(
        "doc_id", "text_hash", F.size("words").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                        lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("hashes"))
    out = hashed.withColumn("n_repeat_words", _repeat_words(F.col("hashes"))).drop("hashes")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(-1)
    for number, least in enumerate(BANDS):
        out = F.when(F.col("n_words") >= least, F.lit(number)).otherwise(out)
    return out


def bucket(top: str, bottom: str) -> Column:
    """ceil(STEPS * share), STEPS at most: the cutoff k / STEPS rejects if it is above k."""
    share = F.expr(f"({STEPS} * {top} + {bottom} - 1) div greatest({bottom}, 1)")
    return F.when(F.col(bottom) == 0, F.lit(0)).otherwise(F.least(F.lit(STEPS), share)).cast("int")


def log_binomial_tail(n: Column, most: Column, p: float) -> Column:
    """Logarithm of P(X <= most) for X binomial with n trials: the exact sum, term by term from 0."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    return F.aggregate(
        F.when(most > 0, F.sequence(F.lit(1), most.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, i: _with(
            acc["term"] + F.log((n - i + 1) / i) + odds,
            lambda term: F.struct(term.alias("term"), (term + F.log1p(F.exp(acc["sum"] - term))).alias("sum"))),
        lambda acc: acc["sum"])


def worst() -> Column:
    """The largest bucket of a document's shares: its rules reject it for every cutoff below."""
    return F.greatest(*[bucket(*parts) for parts in SIGNALS.values()])


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL, price: int = PRICE) -> DataFrame:
    """(stratum, cut): the cutoff in 1/STEPS of every stratum that has a safe and useful one.

    A cutoff is safe if, were a share of ``risk`` or more of the stratum's good documents to be rejected, so few
    rejected ones as were seen would have a probability of at most ``level`` over the number of strata. Rejections
    only grow from one cutoff to the next lower one, so the safe ones are those tested before the first that fails.
    Of them the one is taken whose share of bad documents rejected, less ``price`` times that of good ones, is
    largest and above 0, the higher one of equals. Labels other than 0 and 1, and ids without a document, count
    nowhere; a document labelled twice counts by its largest label; copies of a text are one trial, as good as the
    best of them.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("good"))
    judged = measured.where(~base_failed()).select("doc_id", "text_hash", stratum().alias("stratum"), worst().alias("worst")).join(
        known, "doc_id")
    trials = judged.groupBy("text_hash", "stratum", "worst").agg(F.max("good").alias("good"))
    counted = trials.groupBy("stratum", "worst").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    ladder = counted.groupBy("stratum").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
        F.collect_list(F.struct("worst", "good", "bad")).alias("counts"))  # at most STEPS + 1 entries
    above = lambda field: F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
        c["worst"] > F.col("k"), c[field]).otherwise(0))
    tried = ladder.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(STEPS - 1)))).withColumn(
        "r_good", above("good")).withColumn("r_bad", above("bad"))
    possible = F.col("r_good") < F.col("n_good") * risk  # else the probability is far above the level
    safe = tried.where(possible).where(
        log_binomial_tail(F.col("n_good"), F.col("r_good"), risk) <= math.log(level / len(BANDS)))
    gain = F.col("r_bad") * F.col("n_good") - price * F.col("r_good") * F.col("n_bad")
    return safe.where(gain > 0).groupBy("stratum").agg(F.max_by("k", F.struct(gain, "k")).alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL, price: int = PRICE) -> DataFrame:
    """The features of every row of ``docs``, base_failed, and kept.

    kept is false if base_failed, or if the rules of the document's stratum reject it. A stratum without labels
    enough for a safe cutoff rejects nothing more. No rows give no rows; see ``features`` for nulls.
    """
    measured = written(features(docs), "features")
    cuts = F.broadcast(cutoffs(measured, labels, risk=risk, level=level, price=price))  # one row per stratum, four at most
    rejected = F.coalesce(worst() > F.col("cut"), F.lit(False))
    return measured.withColumn("stratum", stratum()).join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "n_capitals", "n_lines")
