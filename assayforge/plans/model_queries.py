"""Registered queries: training, batch scoring, incremental scoring, submission.

Fitted models have no SQL counterpart, so those queries carry none; the scoring and submission paths
use a fixed formula as the model and are compared in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.functions.hashing import uniform
from assayforge.functions.sequences import SMILES_PATTERN, TEXT_PATTERN, tokenize
from assayforge.functions.udfs import batch_scorer, map_batches, safe_map
from assayforge.operators import features, forest, models, scoring, training, unify, vocabulary
from assayforge.operators.fingerprint import token_fingerprint
from assayforge.plans.metric_queries import sql_alpha
from assayforge.plans.preparation_queries import STATUSES, TEST_CTE, assay_test
from assayforge.plans.registry import SQL, query, spread_table, sql_hash, sql_uniform, table
from assayforge.schemas import LABEL_MISSING
from assayforge.session import new_folder, pinned
from assayforge.streaming import csv_log, incremental

FOREST_BITS = 1024
FOREST_TREES = 100
EMBEDDING_SIZE = 64
TARGETS = ("low", "middle", "high")
MAX_LENGTH = 128


# --- fitted models ----------------------------------------------------------------------------

def document_features(spark, d):
    """Fingerprint bits of the text and one-hot language in one vector."""
    docs = spread_table(spark, d, "documents", "doc_id", "lang", "text")
    tokens = docs.select("doc_id", "lang", tokenize(F.col("text"), TEXT_PATTERN).alias("tokens"))
    bits = token_fingerprint(tokens, "tokens", radius=2, n_bits=FOREST_BITS).drop("tokens")
    vectors = features.add_bits_vector(bits, "bits", FOREST_BITS)
    languages = features.one_hot_pipeline("lang", "lang_vector").fit(docs.select("lang"))
    return features.assemble(languages.transform(vectors), ["fingerprint", "lang_vector"])


@query()
def rf_scores(spark, d):
    """A forest trained on the labelled documents, applied to all of them."""
    rows = pinned(document_features(spark, d).select("doc_id", "features"))
    train = rows.join(table(spark, d, "labels"), "doc_id").select("features", "quality")
    fitted = models.train_random_forest(train, label="quality", trees=FOREST_TREES)
    return forest.score_forest(rows, forest.Forest.read(forest.forest_nodes(fitted)), keep=["doc_id"], out="binds")


@query("SELECT vec_id, TRUE AS equal FROM embeddings")
def forest_agreement(spark, d):
    """Whether a trained forest's exported nodes give each row the model's own score."""
    vectors = features.add_array_vector(table(spark, d, "embeddings"), "embedding", "features")
    rows = vectors.withColumn("upper", (F.col("label") >= 5).cast("int"))
    fitted = models.train_random_forest(rows, label="upper", trees=FOREST_TREES)
    compiled = forest.Forest.read(forest.forest_nodes(fitted))
    both = forest.score_forest(models.score(rows, fitted, keep=["vec_id", "features"], out="own"), compiled,
                               keep=["vec_id", "own"], out="binds")
    return both.select("vec_id", (F.abs(F.col("binds") - F.col("own")) < 1e-12).alias("equal"))


# A forest by rule: complete trees, nodes numbered from the root on, level by level.
RULE_TREES, RULE_DEPTH = 40, 5
RULE_NODES, RULE_INNER = 2 ** (RULE_DEPTH + 1) - 1, 2**RULE_DEPTH - 1
_RULE = {"feature": "(7 * tree + 3 * node + tree * node) % {width}", "cut": "((13 * tree + 5 * node) % 19) / 19.0",
         "probability": "((31 * tree + 17 * node) % 97) / 97.0"}


def rule_forest(spark, width: int, low: float, high: float) -> DataFrame:
    """Nodes of ``RULE_TREES`` trees over ``width`` features whose thresholds lie in [low, high)."""
    nodes = spark.range(RULE_TREES * RULE_NODES).select(
        F.expr(f"int(id div {RULE_NODES})").alias("tree"), F.expr(f"int(id % {RULE_NODES})").alias("node"))
    inner = F.col("node") < RULE_INNER
    cut = F.expr(_RULE["cut"].replace(".0", ".0D"))
    return nodes.select(
        "tree", "node", F.when(inner, F.expr(_RULE["feature"].format(width=width))).alias("feature"),
        F.when(inner, F.lit(low) + cut * (high - low)).alias("threshold"), F.lit(None).cast("array<double>").alias("categories"),
        F.when(inner, 2 * F.col("node") + 1).alias("left"), F.when(inner, 2 * F.col("node") + 2).alias("right"),
        F.expr(_RULE["probability"].replace(".0", ".0D")).alias("probability"))


def _rule_sql(source: str, key: str, array: str, width: int, low: float, high: float) -> str:
    """Walks down every tree for every row of ``source``, a level a subquery."""
    rows = f"SELECT {key} AS key, {array} AS f, tree, 0 AS node FROM {source}, (SELECT unnest(range({RULE_TREES})) AS tree)"
    for _ in range(RULE_DEPTH):
        feature, cut = _RULE["feature"].format(width=width), _RULE["cut"].replace(".0", ".0::DOUBLE")
        rows = (f"SELECT key, f, tree, CASE WHEN f[{feature} + 1] <= {low}::DOUBLE + {cut} * {high - low}::DOUBLE "
                f"THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM ({rows})")
    return (f"SELECT key AS {key}, round(sum({_RULE['probability'].replace('.0', '.0::DOUBLE')}) / {RULE_TREES}, 9) AS binds "
            f"FROM ({rows}) GROUP BY key")


@query(_rule_sql("embeddings", "vec_id", "embedding::DOUBLE[]", EMBEDDING_SIZE, -0.25, 0.25))
def forest_scores(spark, d):
    """A forest that comes as a table of nodes, applied to all vectors."""
    compiled = forest.Forest.read(rule_forest(spark, EMBEDDING_SIZE, -0.25, 0.25))
    scored = forest.score_forest(table(spark, d, "embeddings"), compiled, features="embedding", keep=["vec_id"])
    return scored.withColumn("binds", F.round("binds", 9))


def labelled_vectors(spark, d):
    """Embeddings with three targets, a third of each target's labels missing."""
    known = {
        name: F.when(uniform("vec_id", F.lit(name), seed=6) < 0.33, LABEL_MISSING)
        .otherwise(F.when(F.floor(F.col("label") / 4) == i, 1).otherwise(0))
        for i, name in enumerate(TARGETS)
    }
    return table(spark, d, "embeddings").withColumns(known)


@query()
def masked_lr_scores(spark, d):
    """One weighted classifier per target; a third of each target's labels are missing."""
    rows = features.add_array_vector(labelled_vectors(spark, d), "embedding", "features")
    fitted = models.train_masked_labels(rows, TARGETS)
    return models.score_masked_labels(rows, fitted, keep=["vec_id"])


def _vectors_cte() -> str:
    """x: a row an embedding and target with its label; a: class weights; n: rows with a known label."""
    label = lambda i, name: (
        f"SELECT vec_id, {i} AS j, CASE WHEN {sql_uniform(sql_hash('vec_id', chr(39) + name + chr(39), seed=6))} < 0.33 THEN 2 "
        f"ELSE (label // 4 = {i})::INTEGER END AS y, list_append(embedding::DOUBLE[], 1::DOUBLE) AS x FROM embeddings")
    return f"""x AS ({' UNION ALL '.join(label(i, name) for i, name in enumerate(TARGETS))}),
n AS (SELECT j, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM x GROUP BY j),
a AS (SELECT j, {', '.join(f'{alpha} AS a{c}' for c, alpha in enumerate(sql_alpha('n0', 'n1')))} FROM n),
known AS (SELECT vec_id, j, y, x, CASE WHEN y = 1 THEN a1 ELSE a0 END AS alpha FROM x JOIN a USING (j) WHERE y <> 2),
shared AS (SELECT *, alpha / sum(alpha) OVER (PARTITION BY vec_id) AS share FROM known),
size AS (SELECT count(DISTINCT vec_id) AS rows FROM known)"""


def _gradient_cte(step: str, weights: str) -> str:
    """Loss and gradient at ``weights``, a table of (j, w): a row a target with its list of weights."""
    return f"""z{step} AS (SELECT shared.*, list_dot_product(x, w) AS z FROM shared JOIN {weights} USING (j)),
p{step} AS (SELECT *, 1 / (1 + exp(CASE WHEN y = 1 THEN -z ELSE z END)) AS pt FROM z{step}),
s{step} AS (SELECT j, x, -pow(1 - pt, 2) * ln(pt) * share AS term, share * (CASE WHEN y = 1 THEN 1 ELSE -1 END)
  * (2 * (1 - pt) * ln(pt) - pow(1 - pt, 2) / pt) * pt * (1 - pt) AS pull FROM p{step}),
g{step} AS (SELECT j, place, sum(pull * v) / (SELECT rows FROM size) AS g
  FROM (SELECT j, pull, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS place FROM s{step}) GROUP BY j, place)"""


def fixed_weights() -> np.ndarray:
    """Weights of a repeating pattern, a row a target."""
    place = np.arange(EMBEDDING_SIZE + 1)
    return np.stack([((place * (2 * j + 3)) % 11 - 5) / 4.0 for j in range(len(TARGETS))])


@query(f"""WITH {_vectors_cte()},
w AS (SELECT j, list(((place * (2 * j + 3)) % 11 - 5) / 4.0::DOUBLE ORDER BY place) AS w
  FROM (SELECT unnest(range({len(TARGETS)})) AS j), (SELECT unnest(range({EMBEDDING_SIZE + 1})) AS place) GROUP BY j),
{_gradient_cte('', 'w')}
SELECT {list(TARGETS)}[j + 1] AS target, place::INTEGER AS place, round(g, 9) AS gradient,
  (SELECT round(sum(term) / (SELECT rows FROM size), 9) FROM s) AS loss FROM g""")
def masked_focal_gradient(spark, d):
    """The masked focal loss of a linear classifier of three targets at fixed weights, and its gradient."""
    rows = labelled_vectors(spark, d)
    goal = training.objective(rows, TARGETS)
    loss, gradient = training.loss_and_gradient(training.training_rows(rows, "embedding", TARGETS), goal, fixed_weights())
    return spark.createDataFrame(
        [(name, place, round(float(g), 9), round(loss, 9)) for name, row in zip(TARGETS, gradient) for place, g in enumerate(row)],
        "target string, place int, gradient double, loss double")


FIT_STEPS = 4
FIT_RATE = 0.05


def _fit_sql() -> str:
    start = f"w0 AS (SELECT j, list_resize([0.0::DOUBLE], {EMBEDDING_SIZE + 1}, 0.0) AS w FROM (SELECT unnest(range({len(TARGETS)})) AS j))"
    steps = [start, f"m0 AS (SELECT j, unnest(range({EMBEDDING_SIZE + 1})) AS place, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM w0)"]
    for t in range(1, FIT_STEPS + 1):
        steps.append(_gradient_cte(str(t), f"w{t - 1}"))
        steps.append(f"""u{t} AS (SELECT j, place, w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v
  FROM m{t - 1} JOIN g{t} USING (j, place)),
m{t} AS (SELECT j, place, m, v, w - {FIT_RATE} * (m / (1 - pow(0.9, {t}))) / (sqrt(v / (1 - pow(0.999, {t}))) + 1e-7) AS w FROM u{t}),
w{t} AS (SELECT j, list(w ORDER BY place) AS w FROM m{t} GROUP BY j)""")
    scores = ", ".join(f"round(1 / (1 + exp(-list_dot_product(e, (SELECT w FROM w{FIT_STEPS} WHERE j = {j})))), 8) AS {name}_pred"
                       for j, name in enumerate(TARGETS))
    return f"WITH {_vectors_cte()}, " + ",\n".join(steps) + f"""
SELECT vec_id, {scores} FROM (SELECT vec_id, list_append(embedding::DOUBLE[], 1::DOUBLE) AS e FROM embeddings)"""


@query(_fit_sql())
def masked_focal_fit(spark, d):
    """Probabilities of three targets from a classifier of all of them, after four steps of Adam on the focal loss."""
    rows = labelled_vectors(spark, d)
    model = training.train_focal_labels(rows, TARGETS, features="embedding", optimiser="adam", steps=FIT_STEPS, rate=FIT_RATE)
    scored = training.score_focal_labels(rows, model, features="embedding", keep=["vec_id"])
    return scored.select("vec_id", *[F.round(f"{name}_pred", 8).alias(f"{name}_pred") for name in TARGETS])


# --- scoring with a given function --------------------------------------------------------------

def load_linear():
    """A fixed linear model with a logistic output, standing for any loaded model."""
    weights = ((np.arange(EMBEDDING_SIZE) % 7) - 3) / 10.0

    def predict(vectors):
        return 1.0 / (1.0 + np.exp(-(np.asarray(vectors, dtype="float64") @ weights).reshape(-1, 1)))

    return predict


@query("""SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS score FROM (
    SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) % 7) - 3) / 10.0::DOUBLE)) AS z
    FROM embeddings)""")
def batch_predict(spark, d):
    score = batch_scorer(load_linear, batch_size=32, input_length=EMBEDDING_SIZE)
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vectors.select("vec_id", F.round(F.get(score("v"), 0), 6).alias("score"))


def shortened(text: str) -> str:
    """The text without its last character; an odd length is refused."""
    if len(text) % 2:
        raise ValueError(text)
    return text[:-1]


_EVEN = "CASE WHEN length(p_name) % 2 = 0 THEN left(p_name, -1) {} END"


@query(f"SELECT p_partkey, {_EVEN.format('')} AS or_null, {_EVEN.format('ELSE p_name')} AS or_same FROM part")
def safe_strings(spark, d):
    """A user's function that rejects some values, with null or the value itself in their place."""
    return table(spark, d, "part").select(
        "p_partkey", safe_map(shortened, "null")("p_name").alias("or_null"),
        safe_map(shortened, "keep")("p_name").alias("or_same"))


@query("SELECT vec_id, max(x) AS largest, min(x) AS smallest FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x "
       "FROM embeddings) GROUP BY vec_id")
def batch_ranges(spark, d):
    """A user's function from batch to batch: the largest and smallest component of every vector."""
    def ranges(batch):
        vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
        return batch[["vec_id"]].assign(largest=vectors.max(axis=1), smallest=vectors.min(axis=1))

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return map_batches(vectors, ranges, "vec_id long, largest double, smallest double")


def load_residues():
    """Three scores from the sum of a sequence's token ids."""

    def predict(ids):
        total = np.asarray(ids, dtype="int64").sum(axis=1)
        return np.stack([(total * (k + 1)) % 97 / 97.0 for k in range(3)], axis=1)

    return predict


_TEST_TOKENS = "regexp_extract_all(smiles, '" + SMILES_PATTERN + "')"


@query(f"""WITH {TEST_CTE},
  occ AS (SELECT smiles, unnest({_TEST_TOKENS}) AS token FROM test),
  vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT token FROM occ)),
  sums AS (SELECT smiles, sum(token_id) AS total FROM occ JOIN vocab USING (token) GROUP BY smiles)
  SELECT id::BIGINT AS id, round((total * k) % 97 / 97::DOUBLE, 9) AS binds FROM (
    {' UNION ALL '.join(f'SELECT {s} AS id, total, {k + 1} AS k FROM test JOIN sums USING (smiles)'
                        for k, s in enumerate(STATUSES))}) WHERE id <> -1""")
def submission(spark, d):
    """Test rows pivoted to ids, strings encoded, padded and scored, back to one row per id."""
    wide = unify.pivot_test(assay_test(spark, d), STATUSES)
    tokens = wide.select(tokenize(F.col("smiles"), SMILES_PATTERN).alias("tokens"))
    vocab = pinned(vocabulary.build_vocabulary(tokens, "tokens"))
    scored = scoring.score_sequences(wide, "smiles", vocab, load_residues, max_length=MAX_LENGTH)
    rows = scoring.submission(scoring.spread_scores(scored, "scores", STATUSES), STATUSES)
    return rows.withColumn("binds", F.round("binds", 9))


# --- incremental scoring ------------------------------------------------------------------------

def load_logistic():
    def predict(values):
        return 1.0 / (1.0 + np.exp(-(np.asarray(values, dtype="float64") - 50.0) / 25.0)).reshape(-1, 1)

    return predict


@query("SELECT event_id AS id, round(1 / (1 + exp(-(value - 50) / 25)), 9) AS binds FROM events")
def streaming_score(spark, d):
    """The event files scored as a stream, appended once and read back."""
    events = table(spark, d, "events")
    score = batch_scorer(load_logistic, batch_size=1024)
    stream = incremental.stream_parquet(spark, f"{d}/events.parquet*", events.schema)
    output, checkpoint = new_folder(spark, "scores"), new_folder(spark, "progress")
    incremental.append_once(
        stream, output, checkpoint,
        lambda batch: batch.select(F.col("event_id").alias("id"), F.round(F.get(score("value"), 0), 9).alias("binds")),
    ).awaitTermination()
    return incremental.read_appended(spark, output)


@query(SQL["streaming_score"])
def streaming_csv_scores(spark, d):
    """Event CSV scored in two runs of a stream, a batch written a second time, appended under one header."""
    events = table(spark, d, "events").select("event_id", "value")
    arriving, output, checkpoint = (new_folder(spark, name) for name in ("arriving", "scored-csv", "progress"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("binds", T.DoubleType())])
    score = batch_scorer(load_logistic, batch_size=1024)
    scored = lambda batch: batch.select(F.col("event_id").alias("id"), F.get(score("value"), 0).alias("binds"))
    for run in range(2):
        part = events.where(F.pmod("event_id", F.lit(2)) == run)
        part.write.mode("append").option("header", True).csv(arriving)
        stream = incremental.stream_csv(spark, arriving, events.schema)
        csv_log.append_csv(stream, output, checkpoint, scored).awaitTermination()
    last = csv_log.commits(spark, output).orderBy(F.desc("batch_id")).first()
    csv_log.write_batch(scored(part), output, last["query_id"], last["batch_id"])
    return csv_log.read_csv_log(spark, output, schema).withColumn("binds", F.round("binds", 9))


EVENT_FEATURES = ("value", "event_id % 25 * 4", "user_id % 100")
_EVENT_SQL = "[value::DOUBLE, (event_id % 25 * 4)::DOUBLE, (user_id % 100)::DOUBLE]"


@query(_rule_sql("events", "event_id", _EVENT_SQL, len(EVENT_FEATURES), 0.0, 100.0))
def streaming_forest_nodes(spark, d):
    """A forest that comes as a table of nodes, applied to the event files as a stream."""
    events = table(spark, d, "events")
    compiled = forest.Forest.read(rule_forest(spark, len(EVENT_FEATURES), 0.0, 100.0))
    stream = incremental.stream_parquet(spark, f"{d}/events.parquet*", events.schema)
    output, checkpoint = new_folder(spark, "scores"), new_folder(spark, "progress")

    def scored(batch):
        rows = batch.withColumn("features", F.array(*[F.expr(f"double({e})") for e in EVENT_FEATURES]))
        return forest.score_forest(rows, compiled, keep=["event_id"])

    incremental.append_once(stream, output, checkpoint, scored).awaitTermination()
    return incremental.read_appended(spark, output).withColumn("binds", F.round("binds", 9))


@query()
def streaming_forest(spark, d):
    """A fitted pipeline applied to the event files as a stream."""
    events = table(spark, d, "events")
    stages = Pipeline(stages=[
        *features.one_hot_pipeline("event_type", "type_vector").getStages(),
        features.assembler(["type_vector", "value"]),
        models.random_forest(label="late", trees=10, seed=42),
    ])
    train = events.withColumn("late", (F.hour("ts") >= 12).cast("int"))
    fitted = stages.fit(train)
    stream = incremental.stream_parquet(spark, f"{d}/events.parquet*", events.schema)
    output, checkpoint = new_folder(spark, "scores"), new_folder(spark, "progress")
    incremental.score_stream(stream, fitted, output, checkpoint, keep=["event_id"]).awaitTermination()
    return incremental.read_appended(spark, output)
