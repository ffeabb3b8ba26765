"""Registered queries: class weights, losses, precision-recall areas, evaluation.

Documents with their two labels (2 where unlabelled) are the masked multi-label table; predictions
are hashes of the key, uniform in [0, 1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayforge.functions.hashing import digest_uniform, seeded_hash, uniform
from assayforge.functions.numeric import label_mask, mask_missing
from assayforge.operators import curves, evaluate, losses, metric_state
from assayforge.plans.registry import query, sql_clip, sql_focal, sql_hash, sql_uniform, table
from assayforge.schemas import LABEL_MISSING
from assayforge.session import new_folder
from assayforge.streaming import incremental

LABELS = ["quality", "toxic"]
PREDICTIONS = ["p_quality", "p_toxic"]
EPS, ONE = "1e-7", "(1 - 1e-7)"
ROLES = ("assistant", "system", "user")
N_CLASSES = len(ROLES) + 2


def scored_documents(spark, d):
    labels = [F.coalesce(F.col(c), F.lit(LABEL_MISSING)).alias(c) for c in LABELS]
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", *labels, uniform("doc_id", seed=1).alias("p_quality"), uniform("doc_id", seed=2).alias("p_toxic")
    )


def scored_lines(spark, d):
    """Three 0/1 targets per line and three independent predictions from one hash of its keys."""
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    lines = table(spark, d, "lineitem").select(
        F.array(
            (F.col("l_quantity") > 25).cast("int"), (F.col("l_discount") > 0.05).cast("int"),
            (F.col("l_tax") > 0.04).cast("int"),
        ).alias("bits"),
        seeded_hash(*keys, seed=3).alias("digest"),
    )
    return lines.select("bits", F.array(*[digest_uniform(F.col("digest"), w) for w in range(3)]).alias("p"))


def scored_turns(spark, d):
    """Every turn's role as a token id (2..4), selected by hash, with a probability per class."""
    role = sum([F.when(F.col("role") == r, i + 2).otherwise(0) for i, r in enumerate(ROLES)], F.lit(0))
    turns = table(spark, d, "conversations").select("conv_id", "turn", role.cast("int").alias("original"))
    chosen = uniform("conv_id", "turn", seed=4) < 0.5
    return turns.select(
        "original", F.when(chosen, F.col("original")).otherwise(-1).alias("label"),
        F.array(*[uniform("conv_id", "turn", F.lit(c), seed=5) for c in range(N_CLASSES)]).alias("probabilities"),
    )


DOCS_CTE = f"""docs AS (
  SELECT doc_id, coalesce(quality, 2) AS quality, coalesce(toxic, 2) AS toxic,
    {sql_uniform(sql_hash('doc_id', seed=1))} AS p_quality, {sql_uniform(sql_hash('doc_id', seed=2))} AS p_toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
rows_of AS (
  SELECT 'quality' AS label, quality AS y, p_quality AS p FROM docs WHERE quality <> 2
  UNION ALL SELECT 'toxic', toxic, p_toxic FROM docs WHERE toxic <> 2)"""
_LINE_HASH = sql_hash("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", seed=3)
LINES_CTE = f"""hashed AS (SELECT l_quantity, l_discount, l_tax, {_LINE_HASH} AS h FROM lineitem),
rows_of AS (
  SELECT (l_quantity > 25)::INTEGER AS y, {sql_uniform('h', 0)} AS p FROM hashed
  UNION ALL SELECT (l_discount > 0.05)::INTEGER, {sql_uniform('h', 1)} FROM hashed
  UNION ALL SELECT (l_tax > 0.04)::INTEGER, {sql_uniform('h', 2)} FROM hashed)"""
TURNS_CTE = f"""turns AS (
  SELECT conv_id, turn, list_position({list(ROLES)}, role) + 1 AS original,
    {sql_uniform(sql_hash('conv_id', 'turn', seed=4))} < 0.5 AS chosen FROM conversations),
probs AS (
  SELECT conv_id, turn, original, chosen, c, {sql_uniform(sql_hash('conv_id', 'turn', 'c', seed=5))} AS p
  FROM turns, (SELECT unnest(range({N_CLASSES})) AS c)),
rows_of AS (SELECT (c = original)::INTEGER AS y, p FROM probs WHERE chosen)"""


def sql_alpha(n0: str, n1: str) -> tuple[str, str]:
    raw = [f"(CASE WHEN {n} = 0 THEN 0 ELSE 1 / sqrt({n}) END)" for n in (n0, n1)]
    scale = f"(({n0} + {n1}) / nullif({raw[0]} * {n0} + {raw[1]} * {n1}, 0))"
    return f"({raw[0]} * {scale})", f"({raw[1]} * {scale})"


def sql_pt(y: str, p: str) -> str:
    p = sql_clip(p, EPS, ONE)
    return f"(CASE WHEN {y} = 1 THEN {p} ELSE 1 - {p} END)"


def auc_cte(by: str | None, name: str = "auc", source: str = "rows_of") -> str:
    """SQL of the thresholded area per group: bucket counts, a dense grid, sums from above."""
    g = by if by else "0"
    return f"""{name}_counts AS (
  SELECT {g} AS g, greatest(ceil(p * 199) - 1, 0)::INTEGER AS b, sum(y) AS pos, count(*) AS n
  FROM {source} GROUP BY ALL),
{name}_grid AS (SELECT g, unnest(range(200)) AS b FROM (SELECT DISTINCT g FROM {name}_counts)),
{name}_sums AS (
  SELECT g, b, sum(coalesce(pos, 0)) OVER w AS tp, sum(coalesce(n, 0)) OVER w AS cnt
  FROM {name}_grid LEFT JOIN {name}_counts USING (g, b) WINDOW w AS (PARTITION BY g ORDER BY b DESC)),
{name}_steps AS (
  SELECT g, b, tp, cnt, lead(tp) OVER v AS tp1, lead(cnt) OVER v AS cnt1, first_value(tp) OVER v AS total
  FROM {name}_sums WINDOW v AS (PARTITION BY g ORDER BY b)),
{name}_slopes AS (
  SELECT *, tp - tp1 AS dtp, CASE WHEN cnt = cnt1 THEN 0 ELSE (tp - tp1)::DOUBLE / (cnt - cnt1) END AS slope
  FROM {name}_steps WHERE b < 199),
{name} AS (
  SELECT g, sum(CASE WHEN total = 0 THEN 0 ELSE slope * (dtp + (tp1 - slope * cnt1)
      * ln(CASE WHEN cnt > 0 AND cnt1 > 0 THEN cnt::DOUBLE / cnt1 ELSE 1 END)) / total END) AS pr_auc
  FROM {name}_slopes GROUP BY g)"""


def ap_cte(by: str | None, name: str = "ap", source: str = "rows_of", score: str = "p") -> str:
    """SQL of average precision per group with ties counted together."""
    g = by if by else "0"
    return f"""{name}_ties AS (SELECT {g} AS g, {score} AS s, sum(y) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
{name}_cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cnt FROM {name}_ties
  WINDOW w AS (PARTITION BY g ORDER BY s DESC)),
{name} AS (
  SELECT g, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS n_positive,
    CASE WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * tp::DOUBLE / cnt) / sum(pos) END AS average_precision
  FROM {name}_cum GROUP BY g)"""


_COUNTS = ", ".join(f"count(*) FILTER (WHERE {y} = {c}) AS {y}{c}" for y in LABELS for c in (0, 1))
_ROW_TERMS = {y: (sql_alpha(f"{y}0", f"{y}1"), sql_focal(sql_pt(y, p))) for y, p in zip(LABELS, PREDICTIONS)}


def _row_sum(weighted: bool) -> str:
    parts = []
    for y, ((alpha0, alpha1), term) in _ROW_TERMS.items():
        value = [f"{a} * {term}" if weighted else a for a in (alpha0, alpha1)]
        parts.append(f"(CASE {y} WHEN 0 THEN {value[0]} WHEN 1 THEN {value[1]} ELSE 0 END)")
    return " + ".join(parts)


MACRO_CTE = f"""class_counts AS (SELECT {_COUNTS} FROM docs),
macro AS (SELECT avg(a / nullif(b, 0)) AS loss FROM (
    SELECT {_row_sum(True)} AS a, {_row_sum(False)} AS b FROM docs, class_counts))"""
_POOLED = sql_alpha("n0", "n1")


# --- weights and masks ------------------------------------------------------------------------

@query(f"""WITH {DOCS_CTE},
  c AS (SELECT label, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
    FROM rows_of GROUP BY label)
  SELECT label, n0, n1, round({sql_alpha('n0', 'n1')[0]}, 9) AS alpha0, round({sql_alpha('n0', 'n1')[1]}, 9) AS alpha1
  FROM c""")
def class_weights(spark, d):
    weights = losses.class_weights(scored_documents(spark, d), LABELS)
    return weights.withColumns({c: F.round(c, 9) for c in ("alpha0", "alpha1")})


@query(f"""WITH {DOCS_CTE}, c AS (SELECT {_COUNTS} FROM docs)
  SELECT doc_id, round(CASE quality WHEN 0 THEN {sql_alpha('quality0', 'quality1')[0]}
      WHEN 1 THEN {sql_alpha('quality0', 'quality1')[1]} ELSE 0 END, 9) AS alpha FROM docs, c""")
def row_class_weights(spark, d):
    weighted = losses.row_weights(scored_documents(spark, d), "quality")
    return weighted.select("doc_id", F.round("alpha", 9).alias("alpha"))


@query(f"""WITH {DOCS_CTE} SELECT doc_id, (quality <> 2)::INTEGER AS known, nullif(toxic, 2) AS toxic FROM docs""")
def missing_masks(spark, d):
    return scored_documents(spark, d).select(
        "doc_id", label_mask(F.col("quality"), LABEL_MISSING).alias("known"),
        mask_missing(F.col("toxic"), LABEL_MISSING).alias("toxic"),
    )


# --- losses -----------------------------------------------------------------------------------

@query(f"WITH {DOCS_CTE}, {MACRO_CTE} SELECT round(loss, 9) AS loss FROM macro")
def masked_focal_loss(spark, d):
    loss = losses.masked_focal_loss(scored_documents(spark, d), LABELS, PREDICTIONS)
    return loss.select(F.round("loss", 9).alias("loss"))


@query(f"""WITH {DOCS_CTE}, n AS (
    SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
      sum({sql_focal(sql_pt('y', 'p'))}) FILTER (WHERE y = 0) AS s0,
      sum({sql_focal(sql_pt('y', 'p'))}) FILTER (WHERE y = 1) AS s1 FROM rows_of)
  SELECT round(({_POOLED[0]} * s0 + {_POOLED[1]} * s1) / ({_POOLED[0]} * n0 + {_POOLED[1]} * n1), 9) AS loss FROM n""")
def masked_focal_loss_micro(spark, d):
    loss = losses.masked_focal_loss(scored_documents(spark, d), LABELS, PREDICTIONS, macro=False)
    return loss.select(F.round("loss", 9).alias("loss"))


@query(f"""WITH {DOCS_CTE},
  b AS (SELECT *, doc_id // 256 AS batch FROM docs),
  class_counts AS (SELECT batch, {_COUNTS} FROM b GROUP BY batch)
  SELECT round(avg(loss), 9) AS loss FROM (
    SELECT batch, avg(num / nullif(den, 0)) AS loss FROM (
      SELECT batch, {_row_sum(True)} AS num, {_row_sum(False)} AS den FROM b JOIN class_counts USING (batch))
    GROUP BY batch)""")
def masked_focal_loss_batches(spark, d):
    """Class weights per batch of 256 documents, as in mini-batch training."""
    docs = scored_documents(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 256))
    loss = losses.masked_focal_loss(docs, LABELS, PREDICTIONS, batch="batch")
    return loss.select(F.round("loss", 9).alias("loss"))


@query(f"WITH {LINES_CTE} SELECT round(avg({sql_focal(sql_pt('y', 'p'))}), 9) AS loss FROM rows_of")
def binary_focal_loss(spark, d):
    pairs = losses.flatten_pairs(scored_lines(spark, d), "bits", "p")
    return losses.binary_focal_loss(pairs, "label", "prediction").select(F.round("loss", 9).alias("loss"))


# --- curves -----------------------------------------------------------------------------------

@query(f"WITH {DOCS_CTE}, {auc_cte('label')} SELECT round(avg(pr_auc), 9) AS pr_auc FROM auc")
def pr_auc_macro(spark, d):
    area = curves.masked_pr_auc(scored_documents(spark, d), LABELS, PREDICTIONS)
    return area.select(F.round("pr_auc", 9).alias("pr_auc"))


@query(f"WITH {LINES_CTE}, {auc_cte(None)} SELECT round(pr_auc, 9) AS pr_auc FROM auc")
def pr_auc_micro(spark, d):
    pairs = losses.flatten_pairs(scored_lines(spark, d), "bits", "p")
    return curves.pr_auc(pairs, y="label", p="prediction").select(F.round("pr_auc", 9).alias("pr_auc"))


@query(f"""WITH {DOCS_CTE}, {ap_cte('label', score='round(p, 2)')}
  SELECT g AS label, n, n_positive, round(average_precision, 9) AS average_precision FROM ap""")
def average_precision(spark, d):
    """Per label on scores rounded to two digits, so that most scores are tied."""
    rows = curves.label_rows(scored_documents(spark, d), LABELS, PREDICTIONS)
    ap = curves.average_precision(rows.withColumn("p", F.round("p", 2)), by=["label"])
    return ap.withColumn("average_precision", F.round("average_precision", 9))


@query(f"""WITH {LINES_CTE}, {ap_cte(None)}
  SELECT n, n_positive, round(average_precision, 9) AS average_precision FROM ap""")
def average_precision_micro(spark, d):
    pairs = losses.flatten_pairs(scored_lines(spark, d), "bits", "p")
    ap = curves.average_precision(pairs, y="label", p="prediction")
    return ap.withColumn("average_precision", F.round("average_precision", 9))


# --- evaluation per mode ----------------------------------------------------------------------

def _rounded(df):
    return df.withColumn("value", F.round("value", 9))


@query(f"""WITH {DOCS_CTE}, {MACRO_CTE}, {auc_cte('label')}, {ap_cte('label')}
  SELECT 'loss' AS metric, round(loss, 9) AS value FROM macro
  UNION ALL SELECT 'auc', round(avg(pr_auc), 9) FROM auc
  UNION ALL SELECT 'average_precision', round(avg(average_precision), 9) FROM ap
  UNION ALL SELECT 'n', count(*)::DOUBLE FROM rows_of""")
def evaluate_clf(spark, d):
    return _rounded(evaluate.evaluate(scored_documents(spark, d), "clf", labels=LABELS, predictions=PREDICTIONS))


BATCHES = 4


@query(f"""WITH {DOCS_CTE}, {auc_cte('label')},
  b AS (SELECT *, doc_id % {BATCHES} AS batch FROM docs),
  class_counts AS (SELECT batch, {_COUNTS} FROM b GROUP BY batch)
  SELECT 'loss' AS metric, round(avg(loss), 9) AS value FROM (
    SELECT batch, avg(num / nullif(den, 0)) AS loss FROM (
      SELECT batch, {_row_sum(True)} AS num, {_row_sum(False)} AS den FROM b JOIN class_counts USING (batch))
    GROUP BY batch)
  UNION ALL SELECT 'auc', round(avg(pr_auc), 9) FROM auc
  UNION ALL SELECT 'n', count(*)::DOUBLE FROM rows_of""")
def accumulated_metrics(spark, d):
    """Metrics built up from four batches, one of which comes a second time."""
    docs, folder = scored_documents(spark, d), new_folder(spark, "metrics")
    for batch in (*range(BATCHES), 1):
        rows = docs.where(F.col("doc_id") % BATCHES == batch)
        metric_state.store_state(metric_state.batch_state(rows, LABELS, PREDICTIONS), folder, batch)
    return _rounded(metric_state.metrics(metric_state.read_state(spark, folder)))


@query(f"""WITH {DOCS_CTE}, {auc_cte('label')} SELECT g AS label, round(pr_auc, 9) AS pr_auc FROM auc""")
def streaming_pr_auc(spark, d):
    """The area per label from predictions that arrive file by file."""
    docs = scored_documents(spark, d)
    arriving, folder, checkpoint = (new_folder(spark, name) for name in ("arriving", "metrics", "progress"))
    docs.repartition(BATCHES).write.parquet(arriving)
    stream = incremental.stream_parquet(spark, arriving, docs.schema, files_per_trigger=1)
    metric_state.accumulate_stream(stream, folder, checkpoint, LABELS, PREDICTIONS).awaitTermination()
    return metric_state.areas(metric_state.read_state(spark, folder)).withColumn("pr_auc", F.round("pr_auc", 9))


@query(f"""WITH {LINES_CTE}, {auc_cte(None)}
  SELECT 'loss' AS metric, round(avg({sql_focal(sql_pt('y', 'p'))}), 9) AS value FROM rows_of
  UNION ALL SELECT 'auc', round(pr_auc, 9) FROM auc UNION ALL SELECT 'n', count(*)::DOUBLE FROM rows_of""")
def evaluate_fps(spark, d):
    return _rounded(evaluate.evaluate(scored_lines(spark, d), "fps", bits="bits", predictions="p"))


@query(f"""WITH {TURNS_CTE}, {auc_cte(None)},
  per_token AS (SELECT original, count(*) AS n, count(*) FILTER (WHERE chosen) AS n_selected,
      sum(CASE WHEN chosen THEN {sql_focal(sql_clip('p', EPS, ONE))} ELSE 0 END) AS s
    FROM probs WHERE c = original GROUP BY original)
  SELECT 'loss' AS metric, round(sum(s / sqrt(n)) / sum(n_selected / sqrt(n)), 9) AS value FROM per_token
  UNION ALL SELECT 'auc', round(pr_auc, 9) FROM auc
  UNION ALL SELECT 'n', count(*)::DOUBLE FROM turns WHERE chosen""")
def evaluate_mlm(spark, d):
    rows = scored_turns(spark, d)
    return _rounded(
        evaluate.evaluate(rows, "mlm", label="label", original="original", probabilities="probabilities")
    )
