"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from assayforge.llm import (
    byte_bpe,
    langid,
    line_crf,
    line_dedup,
    lm,
    merkle,
    multi_index,
    packing,
    quality_rules,
    secrets,
    simhash,
    token_files,
    topk,
)
from assayforge.plans.registry import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ids_crc32(ids):
    return F.crc32(ids).cast("long").alias("ids_crc32")


@query
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), WORD_TOKENIZER, end_id=2)
    return packed.select("doc_id", "start", "length", ids_crc32(F.col("ids")), "doc_tokens", "sequence_id", "offset")


@query
def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with the numbers of its lines that go and the digest of the text that stays."""
    out = line_dedup.deduplicated(table(spark, d, "documents"), removed="removed")
    return out.select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query
def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, d, "documents"), BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op5_topk"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
q AS (SELECT min(row) AS row, vec_id, v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, v),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM q, v c WHERE c.row <> q.row AND len(c.v) = len(q.v))
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM s) WHERE rank <= 20"""


@query
def op6_line_crf(spark: SparkSession, d: str) -> DataFrame:
    return line_crf.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(table(spark, d, "documents"), table(spark, d, "labels"))


def _quality_rules_sql() -> str:
    r = quality_rules
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    share = lambda top, bottom: (
        f"CASE WHEN {bottom} = 0 THEN 0 ELSE least({r.STEPS}, ({r.STEPS} * {top} + {bottom} - 1) // greatest({bottom}, 1)) END")
    stratum = "CASE " + " ".join(
        f"WHEN n_words >= {least} THEN {i}" for i, least in reversed(list(enumerate(r.BANDS)))) + " ELSE -1 END"
    worst = f"greatest({', '.join(share(*parts) for parts in r.SIGNALS.values())})"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
             [x FOR x IN string_split(text, chr(10)) IF translate(x, {white}, '') <> ''] AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, i - before))::BIGINT AS n_repeat_words FROM (
          SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS before FROM rep) GROUP BY doc_id),
f AS (SELECT doc_id, text, len(words)::BIGINT AS n_words, length(translate(text, {white}, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{r.SYMBOLS}', '')))::BIGINT AS n_symbols,
             (length(text) - length(translate(text, '{r.CAPITALS}', '')))::BIGINT AS n_capitals,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {stratum} AS stratum, {worst} AS worst FROM f),
known AS (SELECT doc_id, max(quality)::BIGINT AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
trials AS (SELECT stratum, worst, max(good) AS good FROM g JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY text, stratum, worst),
tried AS (SELECT stratum, k, sum(good)::BIGINT AS n_good, sum(1 - good)::BIGINT AS n_bad,
                 coalesce(sum(good) FILTER (worst > k), 0)::BIGINT AS r_good,
                 coalesce(sum(1 - good) FILTER (worst > k), 0)::BIGINT AS r_bad
          FROM trials, (SELECT unnest(generate_series(1, {r.STEPS - 1})) AS k) GROUP BY stratum, k),
safe AS (SELECT *, r_bad * n_good - {r.PRICE} * r_good * n_bad AS gain FROM tried
         WHERE r_good < n_good * {r.RISK} AND ln(list_sum([
           exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({r.RISK}) + (n_good - i) * ln(1 - {r.RISK}))
           FOR i IN generate_series(0, r_good)])) <= ln({r.LEVEL} / {len(r.BANDS)})),
cuts AS (SELECT stratum, arg_max(k, (gain, k)) AS cut FROM safe WHERE gain > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(worst > cut, false) AS kept, n_capitals, n_lines FROM g LEFT JOIN cuts USING (stratum)"""


SQL["op7_quality_rules"] = _quality_rules_sql()


@query
def op8_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(table(spark, d, "documents"), WORD_TOKENIZER, folder, end_id=1)
    return token_files.read_token_files(manifest, folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), ids_crc32(F.col("ids")))


@query
def op9_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "live")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


@query
def op10_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(table(spark, d, "documents"), lowest=1)


@query
def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, c.label = a.label AS same,
             list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.row <> a.row AND len(c.v) = len(a.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
      WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query
def op12_langid(spark: SparkSession, d: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, d, "documents"), PIECES)


@query
def op13_merkle(spark: SparkSession, d: str) -> DataFrame:
    return merkle.verify(table(spark, d, "documents"))


def _merkle_sql(most_levels: int = 8, lang_levels: int = 3) -> str:
    """The tree level by level, for up to 8^8 documents a language and 8^3 languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN
      string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR i IN range(8)]),
      lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))))"""
    steps = [f"""WITH d AS (SELECT *, coalesce('+' || lang, '') AS grp, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{letters}', '{letters.lower()}')")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
a0 AS (SELECT grp, place, leaf AS node FROM p)"""]

    def levels(name: str, count: int) -> None:
        for i in range(count):
            steps.append(f"""{name}{i + 1} AS (SELECT grp, place // 8 AS place,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE max(node) END AS node
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{i}) GROUP BY grp, place // 8)""")
            steps.append(f"""{name}s{i} AS (SELECT x.grp, x.place,
  coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (y.place < x.place), '') AS l,
  coalesce(string_agg(y.node, '' ORDER BY y.place) FILTER (y.place > x.place), '') AS r,
  (SELECT count(*) FROM {name}{i} z WHERE z.grp = x.grp) > 1 AS more
  FROM {name}{i} x JOIN {name}{i} y ON x.grp = y.grp AND x.place // 8 = y.place // 8 GROUP BY ALL)""")

    levels("a", most_levels)
    steps.append(f"""b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS place, node, grp AS lang FROM a{most_levels})""")
    levels("b", lang_levels)
    steps.append("""f0 AS (SELECT p.*, b0.place AS lang_place, b0.node AS subroot, coalesce(altered, leaf) AS folded, '' AS proof
  FROM p JOIN b0 ON b0.lang = p.grp)""")
    at = 0
    for name, count, key, place in (("a", most_levels, "f.grp", "f.place"), ("b", lang_levels, "''", "f.lang_place")):
        for i in range(count):
            steps.append(f"""f{at + 1} AS (SELECT f.* REPLACE (
  CASE WHEN s.more THEN sha256(s.l || f.folded || s.r) ELSE f.folded END AS folded, f.proof || s.l || s.r AS proof)
  FROM f{at} f JOIN {name}s{i} s ON s.grp = {key} AND s.place = {place} // {8**i})""")
            at += 1
    return ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM f{at}, (SELECT node AS root FROM b{lang_levels})"""


SQL["op13_merkle"] = _merkle_sql()


@query
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    packed = corpus_pipeline.run(spark, d)
    return packed.select("doc_id", "start", "length", ids_crc32(F.col("ids")), "doc_tokens", "sequence_id", "offset")


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
