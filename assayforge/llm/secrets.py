"""Secrets in texts: fixed patterns, and owner-specific credentials by corpus-wide ownership."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.llm.batches import document_hash, fresh, map_rows, slices, written

# The patterns, and the least length that each match needs.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "live")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# What a text must hold for a pattern to match; looked for in all texts of a batch at once.
_NEEDS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA",
          "hex": "[0-9a-f]{24}", "live": "[A-Za-z0-9+/_=-]{20}"}

BITS_PER_CHARACTER = 3.0
OWNERS_OF_A_LIVE_ONE = 1
REPOSITORIES_OF_A_LIVE_ONE = 8  # of one owner, who uses it in a few places; an example is in more of them
ODD_PIECE = 12
_SEPARATORS = re.compile(r"[/_=+-]+")
_PLAIN_PIECE = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})*[A-Za-z]?[0-9]*|[A-Z]*[0-9]*|[0-9]+[A-Za-z]{0,2}")

_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def entropy(value: str) -> float:
    """Bits per character by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Letters of both cases or none, digits among them, ``BITS_PER_CHARACTER`` at least, and not a path or slug."""
    return (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            and entropy(value) >= BITS_PER_CHARACTER and not looks_like_path(value))


def looks_like_path(value: str) -> bool:
    """Pieces between separators that are mostly words, numbers or numbered words, none of them long and odd."""
    pieces = [p for p in _SEPARATORS.split(value) if p]
    if len(pieces) < 2:
        return False
    odd = [len(p) for p in pieces if not _PLAIN_PIECE.fullmatch(p)]
    return max(odd, default=0) < ODD_PIECE and 2 * sum(odd) < sum(map(len, pieces))


def base_spans(text: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of a kind's matches, leftmost and non-overlapping, too short ones dropped afterwards."""
    group = 2 if kind == "assign" else 0
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}[kind]
    for match in pattern.finditer(text):
        if len(match[group]) >= LEAST[kind]:
            yield match.start(), match.end(), match[group]


def _scan(batch: pa.Array) -> list[list[dict]]:
    found: list[list[dict]] = [[] for _ in range(len(batch))]
    for number, kind in enumerate(KINDS):
        at = pc.indices_nonzero(pc.match_substring_regex(batch, _NEEDS[kind]))
        for i, text in zip(at.to_pylist(), batch.take(at).to_pylist(), strict=True):
            if kind == "live":
                spans = ((m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if looks_random(m[0]))
            else:
                spans = base_spans(text, kind)
            found[i] += [{"kind": number, "start": s, "end": e, "value": v} for s, e, v in spans]
    for spans in found:
        spans.sort(key=lambda x: (x["start"], x["kind"]))
    return found


def candidates(docs: DataFrame, repository: str | None, owner: str) -> DataFrame:
    """(doc_id, text_hash, repository, owner, spans) of every row, spans with the matched values."""
    places = (docs[repository] if repository else document_hash(docs["text"]), "repository"), (docs[owner], "owner")
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        document_hash(docs["text"]).alias("text_hash"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(name) for c, name in places])

    def run(batches):
        for batch in slices(batches):
            doc_id, text, text_hash, repo, who = batch.columns
            yield {"doc_id": doc_id, "text_hash": text_hash, "repository": repo, "owner": who, "spans": _scan(text)}

    return map_rows(own, run, f"doc_id long, text_hash long, repository string, owner string, spans {_SPANS}")


def scan(docs: DataFrame, *, repository: str | None = None, owner: str = "source") -> DataFrame:
    """Secrets of every row of ``docs``.

    Columns: doc_id, text_hash, spans: array of (kind, start, end, owners, repositories, copied), by
    start, then kind. Kinds are ``assign``, ``access`` and ``hex``, by their patterns, and ``live``:
    random-looking strings of 20 characters or more, paths and slugs left out, that only one owner has in
    the whole corpus, in at most ``REPOSITORIES_OF_A_LIVE_ONE`` repositories, or that one repository
    alone has, whoever owns copies of it. Others are copied examples; base spans say so in ``copied`` and
    stay, other candidates go. Offsets are code points, end exclusive. Without ``repository``, each
    different text is one.

    Ownership is counted by the hash of the value: distinct (hash, owner, repository) first, so a
    string that a third of all documents holds is one row per owner and repository. A null text is empty, a null
    owner is an owner of its own. Repeated rows give rows each and count once. No rows give no rows.
    """
    rows = written(candidates(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.where(F.size("spans") > 0).select("row", "repository", "owner", F.posexplode("spans").alias("i", "s")).select(
        "row", "i", "repository", "owner", "s.kind", "s.start", "s.end", F.md5(F.col("s.value").cast("binary")).alias("h"))
    held = each.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one"))
    known = held.groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    copied = (F.col("repositories") > 1) & (
        (F.col("owners") > OWNERS_OF_A_LIVE_ONE) | (F.col("repositories") > REPOSITORIES_OF_A_LIVE_ONE))
    judged = each.join(known.withColumn("copied", copied), "h").where((F.col("kind") < 3) | ~F.col("copied"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    gathered = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.col("kind").alias("number"), "end", "owners", "repositories", "copied"))).alias("found"))
    spans = F.transform("found", lambda s: F.struct(
        F.element_at(kinds, s["number"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["owners"].alias("owners"), s["repositories"].alias("repositories"),
        s["copied"].alias("copied")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,owners:bigint,repositories:bigint,copied:boolean>>")
    return rows.select("row", "doc_id", "text_hash").join(gathered, "row", "left").select(
        "doc_id", "text_hash", F.coalesce(spans, empty).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, spans: pd.Series, mark: pd.Series) -> pd.Series:
    """The pieces of each text between its spans; a span that begins inside an earlier one only moves its end."""
    def cut(value, found, sign):
        if value is None or found is None:
            return value
        parts, at = [], 0
        for span in found:
            if span["a"] >= at:
                parts += [value[at:span["a"]], sign]
            at = max(at, span["b"])
        return "".join([*parts, value[at:]])

    return pd.Series([cut(*row) for row in zip(text, spans, mark, strict=True)], dtype=object)


def redacted(docs: DataFrame, *, mark: str = "[SECRET]", repository: str | None = None, owner: str = "source") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, and n_chars counted anew where there is one.

    Overlapping spans are replaced as one. Texts without spans and all other columns stay as they are.
    """
    key, spans, doc, text_hash = (fresh(docs, name) for name in ("_text_hash", "_spans", "_id", "_hash"))
    found = scan(docs, repository=repository, owner=owner).where(F.size("spans") > 0).select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash),
        F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))).alias(spans)
    ).dropDuplicates([doc, text_hash])
    marked = docs.withColumn(key, document_hash(docs["text"]))
    both = marked.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash)), "left")
    changed = F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        _replaced(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans), F.lit(mark)))
    out = both.withColumn("text", changed)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)
