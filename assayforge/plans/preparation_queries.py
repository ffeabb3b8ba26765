"""Registered queries: pivoting, splitting, sampling, shuffling, unifying, checking.

The tables stand in for assay data: events are long measurements (user = molecule, event type =
protein), lineitem has three block keys per row, orders plays the test set, part the extra source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.operators import difference, features, quality, sample, split, unify, views
from assayforge.operators.ranking import ordered_rank
from assayforge.operators.reshape import pivot_labels, unpivot_scores
from assayforge.plans import jobs
from assayforge.plans.registry import SQL, query, sql_hash, sql_uint32, table
from assayforge.schemas import EXTRA_COLUMN_NAMES, ID_MISSING, PROTEINS, RAW_COLUMN_NAMES
from assayforge.session import new_folder, pinned
from assayforge.sources import readers, writers
from assayforge.streaming import incremental, stateful

SEED = 42
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BLOCKS = ("l_orderkey", "l_partkey", "l_suppkey")
FLAGS = ("A", "N", "R")
STATUSES = ("F", "O", "P")
DIGITS, ATOMS = "0123456789", "CNOSPFIBcn"


# --- stand-in sources -------------------------------------------------------------------------

def _spelled(column: str):
    return F.translate(F.col(column).cast("string"), DIGITS, ATOMS)


def _spelled_sql(column: str) -> str:
    return f"translate({column}::VARCHAR, '{DIGITS}', '{ATOMS}')"


def assay_train(spark: SparkSession, d: str) -> DataFrame:
    """Long training rows: three blocks, an assembled string, a protein, a label."""
    lines = table(spark, d, "lineitem").select(
        _spelled("l_orderkey").alias("block1"), _spelled("l_partkey").alias("block2"),
        _spelled("l_suppkey").alias("block3"), F.col("l_returnflag").alias("protein_name"),
        (F.col("l_quantity") > 25).cast("tinyint").alias("binds"),
        (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("place"),
    )
    return lines.withColumn("smiles", F.concat("block1", F.lit("("), "block2", F.lit(")"), "block3", F.lit("[Dy]")))


def assay_test(spark: SparkSession, d: str) -> DataFrame:
    """Long test rows: an id per (molecule, protein)."""
    block = _spelled("o_custkey")
    return table(spark, d, "orders").select(
        block.alias("block1"), block.alias("block2"), block.alias("block3"),
        F.concat(F.lit("N="), block, F.lit("[Dy]")).alias("smiles"),
        F.col("o_orderstatus").alias("protein_name"), F.col("o_orderkey").alias("id"),
    )


def assay_extra(spark: SparkSession, d: str) -> DataFrame:
    """Extra rows: a string and a read count, some of them negative."""
    return table(spark, d, "part").select(
        F.concat(F.lit("[Dy]"), _spelled("p_partkey")).alias("smiles"),
        (F.col("p_size") - 25).cast("long").alias("binds"),
    )


def unified(spark: SparkSession, d: str) -> DataFrame:
    long_train = assay_train(spark, d)
    train = unify.pivot_train(long_train, FLAGS, order_by="place")
    test = unify.pivot_test(assay_test(spark, d), STATUSES)
    return unify.unify(train, test, assay_extra(spark, d), seed=SEED, proteins=FLAGS, blocks=long_train)


TRAIN_CTE = f"""train AS (
  SELECT block1, block2, block3, smiles,
    {', '.join(f"coalesce(arg_min(binds, place) FILTER (WHERE protein_name = '{p}'), 0) AS {p}" for p in FLAGS)}
  FROM (SELECT {_spelled_sql('l_orderkey')} AS block1, {_spelled_sql('l_partkey')} AS block2,
          {_spelled_sql('l_suppkey')} AS block3,
          {_spelled_sql('l_orderkey')} || '(' || {_spelled_sql('l_partkey')} || ')'
            || {_spelled_sql('l_suppkey')} || '[Dy]' AS smiles,
          l_returnflag AS protein_name, (l_quantity > 25)::INTEGER AS binds,
          l_linenumber * 1000 + l_quantity AS place FROM lineitem)
  GROUP BY ALL)"""
TEST_CTE = f"""test AS (
  SELECT 'N=' || {_spelled_sql('o_custkey')} || '[Dy]' AS smiles,
    {', '.join(f"coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = '{p}'), -1) AS {p}" for p in STATUSES)}
  FROM orders GROUP BY o_custkey)"""


def held_out_cte(source: str, columns: tuple[str, ...], fraction: float = 0.03) -> str:
    union = " UNION ".join(f"SELECT {c} AS block FROM {source} WHERE {c} IS NOT NULL" for c in columns)
    return f"""blocks AS ({union}),
held AS (SELECT block FROM (
    SELECT block, row_number() OVER (ORDER BY {sql_hash('block', seed=SEED)}) AS rn, count(*) OVER () AS n
    FROM blocks) WHERE rn <= ceil({fraction} * n))"""


UNIFIED_CTE = f"""{TRAIN_CTE}, {TEST_CTE}, {held_out_cte('train', ('block1', 'block2', 'block3'))},
unified AS (
  SELECT smiles, [A, N, R] AS binds,
    (block1 IN (FROM held) OR block2 IN (FROM held) OR block3 IN (FROM held))::INTEGER AS subset FROM train
  UNION ALL SELECT smiles, [2, 2, 2], 2 FROM test
  UNION ALL SELECT '[Dy]' || {_spelled_sql('p_partkey')}, [2, 2, least(greatest(p_size - 25, 0), 1)], 0 FROM part)"""


# --- pivot and unpivot ------------------------------------------------------------------------

@query(f"""SELECT user_id, {', '.join(
    f"coalesce(arg_min(value, event_id) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in EVENT_TYPES)}
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def pivot_first(spark, d):
    return pivot_labels(table(spark, d, "events"), keys=["user_id"], category="event_type", value="value",
                        categories=EVENT_TYPES, order_by="event_id", fill=0)


ARRIVALS = 3


@query(SQL["pivot_first"])
def streaming_pivot(spark, d):
    """The events dealt over several files that arrive one after the other, pivoted with the state kept between them."""
    events = table(spark, d, "events")
    arriving, output, checkpoint = (new_folder(spark, name) for name in ("arriving", "pivot", "progress"))
    events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS))).repartition(ARRIVALS, "part").drop("part").write.parquet(arriving)
    stream = incremental.stream_parquet(spark, arriving, events.schema, files_per_trigger=1)
    stateful.pivot_stream(stream, output, checkpoint, keys=["user_id"], category="event_type", value="value",
                          categories=EVENT_TYPES, order_by="event_id", fill=0).awaitTermination()
    return stateful.read_pivot(spark, output, ["user_id"])


_PIVOT_IDS = "\n UNION ALL ".join(
    f"""SELECT min(o_orderkey) FILTER (WHERE o_orderpriority = '{p}') AS id,
        arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '{p}') AS binds FROM orders GROUP BY o_custkey"""
    for p in PRIORITIES)


@query(f"SELECT id, binds FROM ({_PIVOT_IDS}) WHERE id IS NOT NULL AND binds IS NOT NULL")
def pivot_ids_unpivot(spark, d):
    """One order per customer and priority, that with the smallest key: its id and its price."""
    orders = table(spark, d, "orders").withColumn("pair", F.struct("o_orderkey", "o_totalprice"))
    wide = pivot_labels(orders, keys=["o_custkey"], category="o_orderpriority", value="pair", categories=PRIORITIES,
                        order_by="o_orderkey")
    flat = wide.select(*[F.coalesce(F.col(f"`{p}`.o_orderkey"), F.lit(ID_MISSING)).alias(p) for p in PRIORITIES],
                       *[F.col(f"`{p}`.o_totalprice").alias(f"{p}_pred") for p in PRIORITIES])
    return unpivot_scores(flat, {p: f"{p}_pred" for p in PRIORITIES}, drop_ids=[ID_MISSING]).orderBy("id")


@query(f"""SELECT user_id, {', '.join(
    f"coalesce(arg_min(value, event_id) FILTER (WHERE event_type = '{t}' AND event_id % 3 <> 0), "
    f"min(value) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in EVENT_TYPES)}
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def pivot_null_order(spark, d):
    """A third of the rows have no order: their values count where a user has no others."""
    events = table(spark, d, "events").withColumn("place", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return pivot_labels(events, keys=["user_id"], category="event_type", value="value", categories=EVENT_TYPES,
                        order_by="place", fill=0)


# --- blocks and splits ------------------------------------------------------------------------

@query("SELECT l_orderkey AS block FROM lineitem UNION SELECT l_partkey FROM lineitem "
       "UNION SELECT l_suppkey FROM lineitem")
def distinct_blocks(spark, d):
    return split.distinct_keys(table(spark, d, "lineitem"), BLOCKS)


@query(f"WITH {held_out_cte('lineitem', BLOCKS)} SELECT block FROM held")
def heldout_blocks(spark, d):
    return split.held_out_keys(table(spark, d, "lineitem"), BLOCKS, seed=SEED)


_SPLIT = " OR ".join(f"{c} IN (SELECT block FROM held)" for c in BLOCKS)


@query(f"""WITH {held_out_cte('lineitem', BLOCKS)}
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (CASE WHEN {_SPLIT} THEN 1 ELSE 0 END)::TINYINT AS subset
  FROM lineitem""")
def group_split(spark, d):
    lines = table(spark, d, "lineitem").select(*BLOCKS, "l_linenumber")
    return split.group_split(lines, BLOCKS, seed=SEED)


@query(f"""WITH {held_out_cte('lineitem', BLOCKS)}
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
  WHERE {' AND '.join(f'NOT EXISTS (SELECT 1 FROM held WHERE block = {c})' for c in BLOCKS)}""")
def split_antijoin(spark, d):
    lines = table(spark, d, "lineitem").select(*BLOCKS, "l_linenumber")
    held = split.held_out_keys(lines, BLOCKS, seed=SEED)
    return split.drop_members(lines, BLOCKS, held, "block")


@query(f"""WITH {held_out_cte('lineitem', BLOCKS)}
  SELECT count(*) FILTER (WHERE NOT ({_SPLIT})) AS n_train, count(*) FILTER (WHERE {_SPLIT}) AS n_validation,
    (SELECT count(DISTINCT row) FROM (SELECT (l_orderkey, l_linenumber) AS row, unnest([l_orderkey, l_partkey, l_suppkey]) AS block
      FROM lineitem WHERE NOT ({_SPLIT})) SEMI JOIN held USING (block)) AS n_leaked FROM lineitem""")
def split_leakage(spark, d):
    lines = table(spark, d, "lineitem").select(*BLOCKS)
    held = split.held_out_keys(lines, BLOCKS, seed=SEED)
    return split.leakage(split.group_split(lines, BLOCKS, seed=SEED), BLOCKS, held)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)
     OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def member_rows(spark, d):
    keys = table(spark, d, "part").where("p_size > 40").select("p_partkey")
    lines = table(spark, d, "lineitem").select(*BLOCKS, "l_linenumber")
    return split.keep_members(lines, ["l_partkey", "l_suppkey"], keys, "p_partkey")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT "
       "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def shared_blocks(spark, d):
    lines = table(spark, d, "lineitem")
    return split.shared_keys(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), "l_partkey")


@query(f"""WITH {held_out_cte('lineitem', BLOCKS)}
  SELECT n_shared::INTEGER AS n_shared, count(*) AS n FROM (
    SELECT len(list_distinct(list_filter([l_orderkey, l_partkey, l_suppkey], lambda b: list_contains(h.all_held, b))))
      AS n_shared FROM lineitem, (SELECT list(block) AS all_held FROM held) h) GROUP BY n_shared""")
def overlap_sizes(spark, d):
    """How many held-out blocks each row touches, counted."""
    lines = table(spark, d, "lineitem").select(*BLOCKS)
    cut = split.held_out_cutoff(lines, BLOCKS, seed=SEED)
    held = [F.when(split.any_held_out([c], SEED, cut), F.col(c)) for c in BLOCKS]
    row = F.array(*BLOCKS)
    return (
        lines.select(split.overlap_size(row, F.array_compact(F.array(*held))).alias("n_shared"))
        .groupBy("n_shared").agg(F.count("*").alias("n"))
    )


@query(f"""SELECT doc_id, rn <= ceil(0.2 * n) AS is_test FROM (
    SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('doc_id', seed=SEED)}) AS rn, count(*) OVER () AS n
    FROM documents)""")
def row_split_80_20(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sample.row_split(docs, key=["doc_id"], test_fraction=0.2, seed=SEED)


# --- sampling and order -----------------------------------------------------------------------

@query(f"""SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash('o_orderkey', seed=SEED)}) AS rn
    FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE rn <= 300""")
def balanced_sample(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sample.balanced_sample(orders, label="o_orderstatus", classes=["F", "O"], n=300,
                                  key=["o_orderkey"], seed=SEED)


_SQL_BRANCH = "(SELECT * FROM labels WHERE quality = {c} ORDER BY md5(doc_id::VARCHAR || '|42') LIMIT 40)"


@query(f"{_SQL_BRANCH.format(c=0)} UNION ALL {_SQL_BRANCH.format(c=1)}")
def balanced_sample_sql(spark, d):
    return spark.sql(sample.balanced_sample_sql(f"{d}/labels.parquet", label="quality", classes=[0, 1], n=40,
                                                key="doc_id", seed=SEED))


@query(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash('o_orderkey', seed=SEED)}) AS position
  FROM orders""")
def seeded_shuffle(spark, d):
    """The place of each row in the shuffled table: partition by partition, as the operator left them."""
    shuffled = sample.seeded_shuffle(table(spark, d, "orders").select("o_orderkey"), key=["o_orderkey"], seed=SEED)
    placed = pinned(shuffled.withColumn("_place", F.monotonically_increasing_id()))
    return ordered_rank(placed, order=["_place"]).drop("_place")


@query("""SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch
      ORDER BY md5(doc_id::VARCHAR || '|42|' || epoch::VARCHAR)) AS position
  FROM documents, (SELECT unnest([0, 1, 2]) AS epoch)""")
def epoch_order(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sample.epochs_in_order(docs, key=["doc_id"], seed=SEED, epochs=3)


@query(f"""SELECT batch_id, count(*) AS n, min(o_orderkey) AS first_key, max(position) AS last_position FROM (
    SELECT o_orderkey, position, (position - 1) // 1024 AS batch_id FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash('o_orderkey', seed=SEED)}) AS position FROM orders))
  GROUP BY batch_id""")
def batch_ids(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    batched = sample.batch_ids(orders, key=["o_orderkey"], seed=SEED, batch_size=1024)
    return batched.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("position").alias("last_position")
    )


# --- unified dataset --------------------------------------------------------------------------

@query(f"""WITH {UNIFIED_CTE}
  SELECT smiles, array_to_string(binds, ',') AS binds, subset::TINYINT AS subset,
    replace(smiles, '[Dy]', '[H]') AS smiles_no_linker
  FROM unified""")
def unify_sources(spark, d):
    return unified(spark, d).withColumn("binds", F.array_join(F.col("binds").cast("array<string>"), ","))


@query(SQL["unify_sources"])
def prepare_dataset_files(spark, d):
    """The whole job from files to files: raw train and test Parquet and extra CSV, under their raw column names."""
    folder = new_folder(spark, "raw")
    raw = {short: long for long, short in RAW_COLUMN_NAMES.items()}
    named = lambda names: F.element_at(  # noqa: E731  the stand-in's categories as proteins
        F.create_map(*[F.lit(x) for pair in zip(names, PROTEINS) for x in pair]), F.col("protein_name"))
    train = assay_train(spark, d).withColumns({"protein_name": named(FLAGS), "place": F.col("place").cast("long")})
    train.withColumnsRenamed(raw).write.parquet(f"{folder}/train")
    assay_test(spark, d).withColumn("protein_name", named(STATUSES)).withColumnsRenamed(raw).write.parquet(f"{folder}/test")
    extra = {short: long for long, short in EXTRA_COLUMN_NAMES.items()}
    writers.write_csv(assay_extra(spark, d).withColumnsRenamed(extra), f"{folder}/extra")
    done = jobs.prepare_dataset(spark, *(f"{folder}/{part}" for part in ("train", "test", "extra", "unified")), seed=SEED, order_by="place")
    return done.withColumn("binds", F.array_join(F.col("binds").cast("array<string>"), ","))


@query(f"""WITH {UNIFIED_CTE}
  SELECT * FROM (
    SELECT 'mlm' AS mode, 'train' AS part, count(*) AS n FROM unified
    UNION ALL SELECT 'fps', 'train', count(*) FROM unified WHERE subset <> 1
    UNION ALL SELECT 'fps', 'validation', count(*) FROM unified WHERE subset = 1
    UNION ALL SELECT 'clf', 'train', count(*) FROM unified WHERE subset = 0
    UNION ALL SELECT 'clf', 'validation', count(*) FROM unified WHERE subset = 1)""")
def mode_views(spark, d):
    """Rows each mode trains and validates on."""
    chosen = {(m, "train"): views.mode_filter(m) for m in views.MODE_FEATURES}
    chosen |= {(m, "validation"): F.col("subset") == 1 for m in ("fps", "clf")}
    rows = F.array(*[
        F.struct(F.lit(mode).alias("mode"), F.lit(part).alias("part"), F.count_if(test).alias("n"))
        for (mode, part), test in chosen.items()
    ])
    return unified(spark, d).agg(rows.alias("r")).select(F.inline("r"))


@query(f"""WITH {UNIFIED_CTE}, counts AS (
    SELECT count(*) AS n, count(*) FILTER (WHERE smiles IS NULL) AS no_smiles,
      count(*) FILTER (WHERE len(binds) <> 3) AS bad_size,
      count(*) FILTER (WHERE len(list_filter(binds, lambda b: b NOT IN (0, 1, 2))) > 0) AS bad_label,
      count(*) FILTER (WHERE subset NOT IN (0, 1, 2)) AS bad_subset FROM unified)
  SELECT 'rows' AS "check", n AS observed, n > 0 AS passed FROM counts
  UNION ALL SELECT 'missing_smiles', no_smiles, no_smiles = 0 FROM counts
  UNION ALL SELECT 'wrong_label_size', bad_size, bad_size = 0 FROM counts
  UNION ALL SELECT 'wrong_label_value', bad_label, bad_label = 0 FROM counts
  UNION ALL SELECT 'wrong_subset', bad_subset, bad_subset = 0 FROM counts""")
def quality_report(spark, d):
    return quality.unified_report(unified(spark, d))


@query("""WITH checks AS (
    SELECT 'sample' AS stage, count(*) > 0 AS passed FROM labels
    UNION ALL SELECT 'sample', count(*) FILTER (WHERE doc_id IS NULL) = 0 FROM labels
    UNION ALL SELECT 'scores', count(*) > 0 FROM events
    UNION ALL SELECT 'scores', count(*) FILTER (WHERE event_id IS NULL OR event_id < 0) = 0 FROM events
    UNION ALL SELECT 'scores', count(*) FILTER (WHERE NOT coalesce(value BETWEEN 0 AND 1, FALSE)) = 0 FROM events)
  SELECT stage, count(*) AS checks, bool_and(passed) AS passed
  FROM (SELECT * FROM checks UNION ALL SELECT 'all', passed FROM checks) GROUP BY stage""")
def quality_summary(spark, d):
    """Pass or fail per stage and over all; the raw event values are not scores, so that stage fails."""
    labels = table(spark, d, "labels")
    scores = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("binds"))
    return quality.summary({
        "sample": quality.report(labels, {
            "rows": (F.count("*"), "observed > 0"),
            "missing_keys": (F.count_if(F.col("doc_id").isNull()), "observed = 0"),
        }),
        "scores": quality.submission_report(scores),
    })


@query(f"""SELECT count(*) AS n_rows, sum({sql_uint32(
    "event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type || '|' || props || '|' || "
    "coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '~') || '|' || coalesce(floor(value * 1000)::BIGINT::VARCHAR, '~')")})::VARCHAR AS digest
  FROM events""")
def dataset_checksum(spark, d):
    """Over all columns; times and numbers in a fixed rendering."""
    events = table(spark, d, "events").withColumn("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn(
        "thousandths", F.floor(F.col("value") * 1000))
    return quality.checksum(events, ["event_id", "user_id", "event_type", "props", "time", "thousandths"])


@query("""WITH other AS (
    SELECT * REPLACE (CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
    FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 101 = 0)
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
    CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM orders a FULL JOIN other b ON a.o_orderkey = b.o_orderkey
  WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice""")
def changed_orders(spark, d):
    """The keys in which two versions of the orders differ, found by their checksum trees."""
    orders, folder, key = table(spark, d, "orders"), new_folder(spark, "trees"), F.col("o_orderkey")
    price = F.when(key % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    other = orders.where(key % 97 != 0).withColumn("o_totalprice", price).unionByName(
        orders.where(key % 101 == 0).withColumn("o_orderkey", -key))
    for name, version in (("one", orders), ("two", other)):
        difference.write_tree(version, f"{folder}/{name}", ["o_orderkey"])
    return difference.changed_keys(spark, f"{folder}/one", f"{folder}/two")


_TABLES = ("customer", "documents", "embeddings", "events", "labels", "lineitem", "orders", "part", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in _TABLES))
def row_counts(spark, d):
    counts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("source"), "n") for t in _TABLES]
    return sample.union_by_name(*counts)


@query("SELECT p_name AS smiles, (p_size - 25)::BIGINT AS binds FROM part")
def csv_extra_source(spark, d):
    """The part table written as CSV, read back as the extra source: two of its columns, renamed."""
    folder = new_folder(spark, "extra")
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("new_structure"), (F.col("p_size") - 25).alias("read_count")
    )
    writers.write_csv(part, folder)
    return readers.read_extra_counts(spark, folder)


@query(f"""SELECT event_id, value, {', '.join(
    f"(event_type = '{t}')::INTEGER AS type_{t}" for t in EVENT_TYPES)} FROM events""")
def onehot_features(spark, d):
    events = table(spark, d, "events").select("event_id", "value", "event_type")
    return features.one_hot_columns(events, "event_type", EVENT_TYPES, "type_").drop("event_type")
