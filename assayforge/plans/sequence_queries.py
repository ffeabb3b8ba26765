"""Registered queries: cleaning, tokenising, vocabularies, encoding, masking, fingerprints.

Whole document texts stand in for sequences; strings spelled from lineitem keys are tokenised with
the molecule pattern; conversations are small labelled graphs (turn = node, role = label).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayforge.functions.hashing import uniform
from assayforge.functions.sequences import (
    SMILES_PATTERN,
    TEXT_PATTERN,
    elements,
    pad,
    replace_linker,
    replace_pattern,
    tokenize,
)
from assayforge.operators import fingerprint, losses, masking, views, vocabulary
from assayforge.plans.preparation_queries import SEED, UNIFIED_CTE, unified
from assayforge.plans.registry import query, spread_table, sql_uint32, sql_uniform, table
from assayforge.schemas import FIRST_TOKEN_ID, NOT_SELECTED, TEST
from assayforge.session import new_folder, pinned
from assayforge.sources import readers, writers
from assayforge.streaming import incremental

PAD_LENGTH = 128
MIN_FREQUENCY = 3


def document_tokens(spark, d):
    docs = spread_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", tokenize(F.col("text"), TEXT_PATTERN).alias("tokens"))


def document_vocabulary(spark, d):
    """Tokens seen at least three times, so that rarer ones are encoded as unknown."""
    return pinned(vocabulary.build_vocabulary(document_tokens(spark, d), "tokens", min_frequency=MIN_FREQUENCY))


def encoded_documents(spark, d):
    docs = document_tokens(spark, d)
    return vocabulary.encode_tokens(docs, "tokens", document_vocabulary(spark, d), "ids")


_TOKENS = rf"SELECT doc_id, regexp_extract_all(text, '{TEXT_PATTERN}') AS tokens FROM documents"
_SMILES_TOKENS = "regexp_extract_all(smiles, '" + SMILES_PATTERN + "')"
VOCAB_CTE = f"""tok AS ({_TOKENS}),
occ AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM tok),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER AS token_id
  FROM (SELECT token FROM occ GROUP BY token HAVING count(*) >= {MIN_FREQUENCY})),
enc AS (SELECT doc_id, pos, coalesce(token_id, 1) AS id FROM occ LEFT JOIN vocab USING (token))"""


def _mask_cte(rate: float = 0.15) -> str:
    digest = f"md5(doc_id::VARCHAR || '|' || pos::VARCHAR || '|{SEED}')"
    keep, mask, rand = 1.0 - rate, (1.0 - rate) + 0.8 * rate, (1.0 - rate) + 0.8 * rate + 0.1 * rate
    return f"""sized AS (SELECT count(*) + 2 AS size FROM vocab),
masked AS (
  SELECT doc_id, pos, id AS original,
    CASE WHEN u < {keep!r}::DOUBLE THEN id WHEN u < {mask!r}::DOUBLE THEN 1
         WHEN u < {rand!r}::DOUBLE THEN (2 + floor(v * (size - 2)))::INTEGER ELSE id END AS input,
    CASE WHEN u < {keep!r}::DOUBLE THEN -1 ELSE id END AS label
  FROM (SELECT *, {sql_uniform(digest, 0)} AS u, {sql_uniform(digest, 1)} AS v FROM enc), sized)"""


MASK_CTE = f"{VOCAB_CTE}, {_mask_cte()}"


def masked_documents(spark, d):
    vocab = document_vocabulary(spark, d)
    ids = vocabulary.encode_tokens(document_tokens(spark, d), "tokens", vocab, "ids").select("doc_id", "ids")
    return masking.mask_tokens(ids, "ids", key=["doc_id"], vocab_size=vocab.count() + FIRST_TOKEN_ID, seed=SEED)


def _joined(column):
    return F.array_join(column.cast("array<string>"), " ")


# --- strings and tokens -----------------------------------------------------------------------

@query("""SELECT doc_id, md5(regexp_replace(text, '(tion|eau)', '[H]', 'g')) AS by_pattern,
    md5(replace(text, 'tion', '[H]')) AS by_text FROM documents""")
def linker_replace(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(replace_pattern(text, "(tion|eau)", "[H]")).alias("by_pattern"),
        F.md5(replace_linker(text, linker="tion")).alias("by_text"),
    )


@query(f"""SELECT doc_id, len(tokens)::INTEGER AS n_tokens, len(list_distinct(tokens))::INTEGER AS n_distinct,
    md5(array_to_string(tokens, ' ')) AS digest FROM ({_TOKENS})""")
def tokenize_counts(spark, d):
    return document_tokens(spark, d).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(f"""WITH {UNIFIED_CTE}
  SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER AS token_id
  FROM (SELECT DISTINCT unnest({_SMILES_TOKENS}) AS token FROM unified)""")
def molecule_vocab(spark, d):
    tokens = unified(spark, d).select(tokenize(F.col("smiles"), SMILES_PATTERN).alias("tokens"))
    return vocabulary.build_vocabulary(tokens, "tokens")


@query(f"""SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER AS token_id
  FROM (SELECT DISTINCT unnest(tokens) AS token FROM ({_TOKENS}))""")
def vocab(spark, d):
    return vocabulary.build_vocabulary(document_tokens(spark, d), "tokens")


@query(f"""SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM ({_TOKENS}))
    GROUP BY token HAVING count(*) >= 5 ORDER BY n DESC, token LIMIT 1000)""")
def vocab_min_freq(spark, d):
    return vocabulary.build_vocabulary(document_tokens(spark, d), "tokens", min_frequency=5, max_size=1000)


# --- encoding and masking ---------------------------------------------------------------------

@query(f"""WITH {VOCAB_CTE}
  SELECT doc_id, len(tokens)::INTEGER AS n_tokens, array_to_string(
      list_resize(coalesce(ids, []), greatest({PAD_LENGTH}, len(tokens)), 0), ' ') AS ids
  FROM tok LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM enc GROUP BY doc_id) USING (doc_id)""")
def encode_pad(spark, d):
    """Whole texts as ids; those shorter than 128 tokens are padded, longer ones stay whole."""
    return encoded_documents(spark, d).select(
        "doc_id", F.size("tokens").alias("n_tokens"),
        _joined(pad(F.col("ids"), PAD_LENGTH, "keep")).alias("ids"),
    )


JOINED_LIMIT = 100  # tokens from which ``encode_join`` joins, far fewer than the documents have


@query(f"""WITH {VOCAB_CTE}
  SELECT doc_id, len(tokens)::INTEGER AS n_tokens, coalesce(ids, '') AS ids
  FROM tok LEFT JOIN (SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM enc GROUP BY doc_id) USING (doc_id)""")
def encode_join(spark, d):
    """Whole texts as ids with a vocabulary that is above the size of a lookup table, so it is joined."""
    docs = document_tokens(spark, d).withColumns({"_row": F.lit("kept"), "_at": F.lit(1)})
    encoded = vocabulary.encode_tokens(docs, "tokens", document_vocabulary(spark, d), "ids", max_lookup_rows=JOINED_LIMIT)
    return encoded.where("_row = 'kept' AND _at = 1").select("doc_id", F.size("tokens").alias("n_tokens"), _joined(F.col("ids")).alias("ids"))


@query(f"""WITH {MASK_CTE}
  SELECT doc_id, string_agg(input, ' ' ORDER BY pos) AS input, string_agg(label, ' ' ORDER BY pos) AS label,
    (count(*) FILTER (WHERE label <> -1))::INTEGER AS n_selected FROM masked GROUP BY doc_id""")
def mlm_mask(spark, d):
    label = F.col("target.label")
    return masked_documents(spark, d).where(F.size("ids") > 0).select(
        "doc_id", _joined(F.col("masked")).alias("input"), _joined(label).alias("label"),
        F.size(F.filter(label, lambda v: v != -1)).alias("n_selected"),
    )


@query(f"""WITH {VOCAB_CTE}
  SELECT id::INTEGER AS token_id, count(*) AS n, round(1 / sqrt(count(*)), 9) AS alpha
  FROM enc WHERE id >= 2 GROUP BY id""")
def token_weights(spark, d):
    ids = elements(encoded_documents(spark, d), "ids", value="id")
    return losses.token_weights(ids, "id").withColumn("alpha", F.round("alpha", 9))


def scored_targets(spark, d):
    """(label, original, p) of every position; the probability is drawn for the selected ones alone."""
    rows = masking.target_rows(masked_documents(spark, d), "target", "doc_id")
    drawn = F.when(F.col("label") != NOT_SELECTED, uniform("doc_id", "position", seed=7))
    return rows.select("label", "original", drawn.alias("p"))


@query(f"""WITH {MASK_CTE},
  p AS (SELECT *, least(greatest({sql_uniform("md5(doc_id::VARCHAR || '|' || pos::VARCHAR || '|7')")},
      1e-7), 1 - 1e-7) AS p FROM masked),
  per_token AS (SELECT original, count(*) AS n, count(*) FILTER (WHERE label <> -1) AS n_selected,
      sum(CASE WHEN label <> -1 THEN -pow(1 - p, 2) * ln(p) ELSE 0 END) AS s FROM p GROUP BY original)
  SELECT round(sum(s / sqrt(n)) / sum(n_selected / sqrt(n)), 9) AS loss FROM per_token WHERE original >= 2""")
def masked_token_loss(spark, d):
    loss = losses.masked_token_loss(scored_targets(spark, d), original="original", label="label", prediction="p")
    return loss.select(F.round("loss", 9).alias("loss"))


# --- fingerprints -----------------------------------------------------------------------------

def _window_bits(n_bits: int, radius: int) -> str:
    reaches = [
        f"SELECT doc_id, {sql_uint32(f_text)} % {n_bits} AS bit FROM placed" for f_text in (
            f"'{r}|' || array_to_string(tokens[greatest(pos - {r}, 1):pos + {r}], ' ')" for r in range(radius + 1))
    ]
    return " UNION ALL ".join(reaches)


@query(f"""WITH tok AS ({_TOKENS}),
  placed AS (SELECT doc_id, tokens, unnest(generate_series(1, len(tokens))) AS pos FROM tok),
  bits AS (SELECT DISTINCT doc_id, bit FROM ({_window_bits(2048, 2)}))
  SELECT doc_id, len(tokens) > 0 AS is_valid, coalesce(n_bits, 0)::INTEGER AS n_bits, coalesce(bits, '') AS bits
  FROM tok LEFT JOIN (SELECT doc_id, count(*) AS n_bits, string_agg(bit, ' ' ORDER BY bit) AS bits
    FROM bits GROUP BY doc_id) USING (doc_id)""")
def token_fingerprint(spark, d):
    marked = fingerprint.token_fingerprint(document_tokens(spark, d), "tokens")
    return marked.select("doc_id", "is_valid", F.size("bits").alias("n_bits"), _joined(F.col("bits")).alias("bits"))


def _round_sql(k: int, hand: str = "") -> str:
    """``around`` sums up a turn's neighbours; ``hand`` is SQL of further words of the code."""
    shown = "md5(bond || '|' || code)"
    word = "('0x' || substr({}, {}, 8))::BIGINT"
    return f"""around{k} AS (
  SELECT l.g, l.at AS v, count(*) AS n, sum({word.format(shown, 1)}) AS s0, sum({word.format(shown, 9)}) AS s1
  FROM links l JOIN code{k - 1} c ON l.g = c.g AND l.other = c.v GROUP BY l.g, l.at),
{_hand_sql(k) if hand else ''}code{k} AS (
  SELECT c.g, c.v, md5('{k}|' || code || '|' || coalesce(n, 0) || '|' || coalesce(s0, 0) || '|'
      || coalesce(s1, 0){hand}) AS code
  FROM code{k - 1} c LEFT JOIN around{k} a ON c.g = a.g AND c.v = a.v
  {f'LEFT JOIN hand{k} h ON c.g = h.g AND c.v = h.v' if hand else ''})"""


def _hand_sql(k: int) -> str:
    """Handedness of the turns that have a parity and two unlike neighbours."""
    shown = "md5(bond || '|' || code)"
    return f"""hand{k} AS (SELECT l.g, l.at AS v,
    any_value(parity) * CASE WHEN arg_min({shown}, l.other) < arg_max({shown}, l.other) THEN 1 ELSE -1 END AS hand
  FROM links l JOIN code{k - 1} c ON l.g = c.g AND l.other = c.v JOIN parities p ON l.g = p.g AND l.at = p.v
  GROUP BY l.g, l.at HAVING count(DISTINCT {shown}) = 2),
"""


@query(f"""WITH e AS (SELECT a.conv_id AS g, a.turn AS src, b.turn AS dst, '1' AS bond
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
  links AS (SELECT g, src AS at, dst AS other, bond FROM e UNION ALL SELECT g, dst, src, bond FROM e),
  code0 AS (SELECT conv_id AS g, turn AS v, md5('0|' || role) AS code FROM conversations),
  {_round_sql(1)}, {_round_sql(2)},
  bits AS (SELECT DISTINCT g, ('0x' || substr(code, 1, 8))::BIGINT % 2048 AS bit
    FROM (FROM code0 UNION ALL FROM code1 UNION ALL FROM code2))
  SELECT g AS conv_id, count(*)::INTEGER AS n_bits, string_agg(bit, ' ' ORDER BY bit) AS bits FROM bits GROUP BY g""")
def graph_fingerprint(spark, d):
    turns, edges = conversation_graphs(spark, d)
    bits = fingerprint.graph_fingerprint(turns, edges, graph="conv_id", node="turn", label="role")
    return bits.select("conv_id", F.size("bits").alias("n_bits"), _joined(F.col("bits")).alias("bits"))


def conversation_graphs(spark, d):
    """Turns as nodes and an edge from each turn to the next one."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("dst"))
    edges = turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", F.col("turn").alias("src"), "dst", F.lit("1").alias("bond")
    )
    return turns, edges


_HAND = " || coalesce('|' || hand, '')"
_GRAPH_CTE = """e AS (SELECT a.conv_id AS g, a.turn AS src, b.turn AS dst, '1' AS bond
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
  links AS (SELECT g, src AS at, dst AS other, bond FROM e UNION ALL SELECT g, dst, src, bond FROM e),
  code0 AS (SELECT conv_id AS g, turn AS v, md5('0|' || role) AS code FROM conversations)"""


# Edges that a neighbourhood covers as lists, numbered by their first turn.
@query(f"""WITH {_GRAPH_CTE},
  parities AS (SELECT conv_id AS g, turn AS v, CASE WHEN turn % 3 = 0 THEN 1 ELSE -1 END AS parity FROM conversations WHERE turn % 3 < 2),
  {_round_sql(1, _HAND)}, {_round_sql(2, _HAND)},
  at1 AS (SELECT g, src AS v, src AS edge FROM e UNION SELECT g, dst, src FROM e),
  near AS (SELECT g, links.at AS v, other FROM links UNION SELECT g, v, v FROM at1),
  at2 AS (SELECT DISTINCT near.g, near.v, edge FROM near JOIN at1 ON near.g = at1.g AND near.other = at1.v),
  covered AS (SELECT g, v, 1 AS k, string_agg(edge, ' ' ORDER BY edge) AS edges FROM at1 GROUP BY ALL
    UNION ALL SELECT g, v, 2, string_agg(edge, ' ' ORDER BY edge) FROM at2 GROUP BY ALL),
  coded AS (SELECT *, 1 AS k FROM code1 UNION ALL SELECT *, 2 FROM code2),
  kept AS (SELECT g, edges, arg_min(code, k::VARCHAR || code) AS code FROM coded JOIN covered USING (g, v, k) GROUP BY g, edges),
  bits AS (SELECT DISTINCT g, ('0x' || substr(code, 1, 8))::BIGINT % 2048 AS bit
    FROM (SELECT g, code FROM code0 UNION ALL SELECT g, code FROM kept))
  SELECT g AS conv_id, count(*)::INTEGER AS n_bits, string_agg(bit, ' ' ORDER BY bit) AS bits FROM bits GROUP BY g""")
def chiral_fingerprint(spark, d):
    """Fingerprints that tell mirror images apart and count neighbourhoods with the same edges once."""
    turns, edges = conversation_graphs(spark, d)
    marked = turns.withColumn("parity", F.when(F.col("turn") % 3 == 0, 1).when(F.col("turn") % 3 == 1, -1))
    bits = fingerprint.graph_fingerprint(
        marked, edges.withColumns({"after": F.lit(1), "before": F.lit(0)}), graph="conv_id", node="turn", label="role",
        parity="parity", places=("after", "before"), distinct_environments=True)
    return bits.select("conv_id", F.size("bits").alias("n_bits"), _joined(F.col("bits")).alias("bits"))


# --- training records and their views -----------------------------------------------------------

VIEW_LENGTH = 64
_CLEAN_TOKENS = "regexp_extract_all(replace(smiles, '[Dy]', '[H]'), '" + SMILES_PATTERN + "')"
VIEW_CTE = f"""{UNIFIED_CTE},
  occ AS (SELECT name, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
    FROM (SELECT smiles AS name, {_SMILES_TOKENS} AS tokens FROM unified)),
  vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT token FROM occ)),
  enc AS (SELECT name, array_to_string(list_resize(ids, greatest({VIEW_LENGTH}, len(ids)), 0), ' ') AS input
    FROM (SELECT name, list(id ORDER BY pos) AS ids FROM occ JOIN vocab USING (token) GROUP BY name))"""


def stored_records(spark, d):
    """Training records written by subset and read back, keyed by the string, and their vocabulary."""
    rows = pinned(unified(spark, d).withColumn("name", F.col("smiles")))
    folder = new_folder(spark, "records")
    writers.write_records(views.make_records(rows, keep=["name"]), folder)
    records = readers.read_records(spark, folder)
    return records, pinned(vocabulary.build_vocabulary(records, "smiles"))


# The vocabulary is that of all rows; only the rows of the view are then tokenised and encoded, by a map.
@query(f"""WITH {UNIFIED_CTE},
  vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id
    FROM (SELECT DISTINCT unnest({_SMILES_TOKENS}) AS token FROM unified)),
  ids AS (SELECT map(list(token), list(id)) AS id_of FROM vocab),
  own AS MATERIALIZED (SELECT smiles AS name, binds, {_SMILES_TOKENS} AS tokens FROM unified WHERE subset = 0)
  SELECT name, array_to_string(list_resize([id_of[t] FOR t IN tokens], greatest({VIEW_LENGTH}, len(tokens)), 0), ' ') AS input,
    array_to_string(binds, ',') AS binds FROM own, ids""")
def view_clf(spark, d):
    """Inputs and labels of the rows that classification trains on."""
    records, vocab = stored_records(spark, d)
    view = views.training_view(records, "clf", vocab, key=["name"], max_length=VIEW_LENGTH, on_overflow="keep")
    return view.select("name", _joined(F.col("input")).alias("input"),
                       F.array_join(F.col("binds").cast("array<string>"), ",").alias("binds"))


@query(f"""WITH {VIEW_CTE},
  placed AS (SELECT smiles AS doc_id, tokens, unnest(generate_series(1, len(tokens))) AS pos
    FROM (SELECT smiles, {_CLEAN_TOKENS} AS tokens FROM unified WHERE subset = 1)),
  bits AS (SELECT DISTINCT doc_id, bit FROM ({_window_bits(2048, 2)}))
  SELECT name, input, string_agg(bit, ' ' ORDER BY bit) AS ecfp FROM enc JOIN bits ON name = doc_id GROUP BY ALL""")
def view_fps(spark, d):
    """Inputs and set bits of the rows that fingerprint prediction validates on."""
    records, vocab = stored_records(spark, d)
    view = views.training_view(records, "fps", vocab, key=["name"], max_length=VIEW_LENGTH, on_overflow="keep",
                               validation=True)
    return view.select("name", _joined(F.col("input")).alias("input"), _joined(F.col("ecfp")).alias("ecfp"))


@query(f"""WITH {UNIFIED_CTE}
  SELECT smiles AS name, array_to_string({_SMILES_TOKENS}, ' ') AS tokens, array_to_string(binds, ',') AS binds
  FROM unified WHERE subset = 2""")
def test_records(spark, d):
    """The rows to be scored, picked from the stored records: only their files are read."""
    rows = unified(spark, d).withColumn("name", F.col("smiles"))
    folder = new_folder(spark, "records")
    writers.write_records(views.make_records(rows, keep=["name"]), folder)
    chosen = readers.read_records(spark, folder, subset=TEST)
    return chosen.select("name", F.array_join("smiles", " ").alias("tokens"),
                         F.array_join(F.col("binds").cast("array<string>"), ",").alias("binds"))


def _padded_sql(column: str, fill: int) -> str:
    return f"array_to_string(list_resize(list({column} ORDER BY pos), greatest({VIEW_LENGTH}, count(*)), {fill}), ' ')"


@query(f"""WITH {UNIFIED_CTE},
  occ AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos
    FROM (SELECT smiles AS doc_id, {_SMILES_TOKENS} AS tokens FROM unified)),
  vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT token FROM occ)),
  enc AS (SELECT doc_id, pos, id FROM occ JOIN vocab USING (token)),
  {_mask_cte()}
  SELECT doc_id AS name, {_padded_sql('input', 0)} AS input, {_padded_sql('label', -1)} AS label FROM masked GROUP BY doc_id""")
def view_mlm(spark, d):
    """Masked inputs and selected labels of all rows; padding is never selected."""
    records, vocab = stored_records(spark, d)
    view = views.training_view(records, "mlm", vocab, key=["name"], max_length=VIEW_LENGTH, on_overflow="keep", seed=SEED)
    return view.select("name", _joined(F.col("input")).alias("input"), _joined(F.col("target.label")).alias("label"))


@query(f"""SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER AS token_id
  FROM (SELECT DISTINCT unnest(tokens) AS token FROM ({_TOKENS}))""")
def vocabulary_text(spark, d):
    """The vocabulary of all documents as text files, a token a line, and back with the ids of the lines."""
    folder = new_folder(spark, "vocabulary-text")
    writers.export_vocabulary_text(vocabulary.build_vocabulary(document_tokens(spark, d), "tokens"), folder)
    return readers.import_vocabulary_text(spark, folder)


# --- incremental preparation ------------------------------------------------------------------

@query(r"""WITH tok AS (SELECT p_partkey, p_name, regexp_extract_all(p_name, '([A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r])')
      AS tokens FROM part),
  occ AS (SELECT p_partkey, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tok),
  vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT token FROM occ))
  SELECT p_partkey, replace(any_value(p_name), 'ring', '[H]') AS clean, string_agg(id, ' ' ORDER BY pos) AS ids
  FROM occ JOIN vocab USING (token) JOIN tok USING (p_partkey) GROUP BY p_partkey""")
def streaming_prepare(spark, d):
    """Names cleaned and encoded file by file as a stream, read back from what it appended."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    tokens = part.select(tokenize(F.col("p_name"), TEXT_PATTERN).alias("tokens"))
    folder = new_folder(spark, "vocabulary")
    writers.write_vocabulary(vocabulary.build_vocabulary(tokens, "tokens"), folder)
    vocab = readers.read_vocabulary(spark, folder)
    stream = incremental.stream_parquet(spark, f"{d}/part.parquet*", part.schema)
    output, checkpoint = new_folder(spark, "prepared"), new_folder(spark, "progress")
    incremental.prepare_stream(
        stream, "p_name", vocab, output, checkpoint, pattern=TEXT_PATTERN,
        clean=lambda text: replace_linker(text, linker="ring"),
    ).awaitTermination()
    done = incremental.read_appended(spark, output)
    return done.select("p_partkey", "clean", _joined(F.col("ids")).alias("ids"))
