from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayforge import schemas, session
from assayforge.functions.sequences import replace_linker
from assayforge.functions.udfs import safe_map
from assayforge.operators import quality, views
from assayforge.plans import jobs
from assayforge.sources import readers, writers

RAW = {v: k for k, v in schemas.RAW_COLUMN_NAMES.items()}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory, assay_train, assay_test):
    folder = tmp_path_factory.mktemp("raw")
    assay_train.withColumnsRenamed(RAW).repartition(3).write.parquet(str(folder / "train.parquet"))
    assay_test.withColumnsRenamed(RAW).write.parquet(str(folder / "test.parquet"))
    (folder / "extra.csv").write_text(
        "other,new_structure,read_count\n1,CC[Dy],0\n2,CN,1\n3,\"C,O\",7\n4,CCl,-1\n")
    return folder


@pytest.fixture(scope="module")
def built(spark, inputs):
    out = {n: str(inputs / f"{n}.out") for n in ("unified", "vocab", "records", "submission")}
    jobs.prepare_dataset(spark, str(inputs / "train.parquet"), str(inputs / "test.parquet"),
                         str(inputs / "extra.csv"), out["unified"], partitions=4, order_by="id")
    jobs.extract_vocabulary(spark, out["unified"], out["vocab"])
    jobs.build_records(spark, out["unified"], out["records"])
    return out


@pytest.fixture()
def load_quarters():
    return lambda: lambda ids: np.full((len(ids), 3), 0.25)


def test_unified_dataset(spark, built):
    df = spark.read.parquet(built["unified"])
    assert df.count() == 5 + 3 + 4
    assert df.schema["binds"].dataType.simpleString() == "array<tinyint>"
    assert df.schema["subset"].dataType.simpleString() == "tinyint"
    assert df.where("subset = 2").count() == 3
    files = [f for f in Path(built["unified"]).iterdir() if f.suffix == ".parquet"]
    assert 1 <= len(files) <= 4


def test_vocabulary_ids_and_text_form(spark, built, tmp_path):
    vocab = readers.read_vocabulary(spark, built["vocab"])
    rows = vocab.orderBy("token_id").collect()
    tokens = [r["token"] for r in rows]
    assert tokens == sorted(tokens, key=str.encode) and [r["token_id"] for r in rows] == list(range(2, len(rows) + 2))
    text = str(tmp_path / "vocab_text")
    writers.export_vocabulary_text(vocab, text)
    back = readers.import_vocabulary_text(spark, text)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vocab.collect()))


def test_text_vocabulary_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("C\n\n  N \r\nO,\"x\"\n\n")
    rows = readers.import_vocabulary_text(spark, str(path)).collect()
    assert [(r["token"], r["token_id"]) for r in rows] == [("C", 2), ("N", 3), ('O,"x"', 4)]


def test_records_are_pruned_by_subset(spark, built):
    records = readers.read_records(spark, built["records"])
    assert records.count() == 12 and set(records.columns) == {"smiles", "ecfp", "binds", "subset"}
    plan = readers.read_records(spark, built["records"], subset=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan
    assert readers.read_records(spark, built["records"], subset=2).count() == 3


def test_mode_views(spark, built):
    records = readers.read_records(spark, built["records"]).withColumn("k", F.monotonically_increasing_id())
    vocab = readers.read_vocabulary(spark, built["vocab"])
    n = {s: records.where(F.col("subset") == s).count() for s in (0, 1, 2)}
    clf = views.training_view(records, "clf", vocab, max_length=16)
    fps = views.training_view(records, "fps", vocab, max_length=16)
    mlm = views.training_view(records, "mlm", vocab, key=["k"], max_length=16)
    assert (clf.columns, clf.count()) == (["binds", "input"], n[0])
    assert (fps.columns, fps.count()) == (["ecfp", "input"], n[0] + n[2])
    assert (mlm.columns, mlm.count()) == (["k", "input", "target"], 12)
    dense = views.training_view(records, "fps", vocab, max_length=16, dense_bits=2048).first()["ecfp"]
    assert len(dense) == 2048 and set(dense) <= {0, 1} and sum(dense) > 0
    assert all(len(r["input"]) == 16 for r in mlm.collect())
    assert views.training_view(records, "mlm", vocab, key=["k"], validation=True) is None
    assert views.training_view(records, "clf", vocab, max_length=16, validation=True).count() == n[1]
    with pytest.raises(ValueError):
        views.training_view(records, "mlm", vocab)


def test_failed_cleaning_has_no_bits(spark):
    def strict(text):
        if "Br" in text:
            raise ValueError(text)
        return text

    clean = safe_map(strict)
    df = spark.createDataFrame([("CBr",), ("CN",)], "smiles string").select(
        "smiles", F.array(F.lit(2)).cast("array<tinyint>").alias("binds"), F.lit(0).cast("tinyint").alias("subset"),
        clean(replace_linker(F.col("smiles"))).alias("smiles_no_linker"))
    rows = {"".join(r["smiles"]): r["ecfp"] for r in views.make_records(df).collect()}
    assert rows["CBr"] == [] and len(rows["CN"]) > 0


def test_submission_job_and_validation(spark, inputs, built, load_quarters):
    rows = jobs.write_submission(spark, str(inputs / "test.parquet"), built["vocab"], load_quarters, built["submission"])
    assert sorted(r["id"] for r in rows.collect()) == [100, 101, 102, 103, 104, 105]
    result = {r["stage"]: (r["checks"], r["passed"]) for r in jobs.validate_outputs(
        spark, unified=built["unified"], vocab=built["vocab"], submission=built["submission"]).collect()}
    assert result == {"unified": (5, True), "vocabulary": (4, True), "submission": (3, True), "all": (12, True)}


def test_quality_report_finds_faults(spark):
    df = spark.createDataFrame([("C", [0, 1], 0), (None, [0, 1, 5], 7)], "smiles string, binds array<byte>, subset byte")
    failed = {r["check"]: r["observed"] for r in quality.unified_report(df).where("NOT passed").collect()}
    assert failed == {"missing_smiles": 1, "wrong_label_size": 1, "wrong_label_value": 1, "wrong_subset": 1}


def test_missing_inputs_fail_before_any_job(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        jobs.prepare_dataset(spark, "/nowhere/train", "/nowhere/test", "/nowhere/extra", str(tmp_path / "x"))
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require_columns(spark.range(1), ["id", "z"])


def test_csv_columns_by_name_and_append(spark, inputs, tmp_path):
    extra = readers.read_extra_counts(spark, str(inputs / "extra.csv"))
    assert sorted((r["smiles"], r["binds"]) for r in extra.collect()) == [("C,O", 7), ("CC[Dy]", 0), ("CCl", -1), ("CN", 1)]
    out = str(tmp_path / "scores")
    for batch in (spark.range(3), spark.range(3, 5)):
        writers.write_csv(batch.select("id", F.lit(0.5).alias("binds")), out, append=True)
    back = spark.read.schema(schemas.SUBMISSION).option("header", True).csv(out)
    assert sorted(r["id"] for r in back.collect()) == [0, 1, 2, 3, 4]
    writers.write_csv(spark.range(1), out)
    assert readers.row_count(readers.read_csv(spark, out, schemas.SUBMISSION, columns=["id"])) == 1


def test_parquet_sources(spark, inputs):
    train = str(inputs / "train.parquet")
    pruned = readers.read_parquet(spark, train, schema=schemas.RAW_TRAIN, columns=["molecule_smiles"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<molecule_smiles:string>" in plan
    files = sorted(str(f) for f in Path(train).glob("*.parquet"))
    assert readers.read_parquet(spark, *files).count() == 12
    by_sql = readers.parquet_relation(spark, train, "binds = 1")
    assert by_sql.count() == 8
    assert "PushedFilters: [IsNotNull(binds), EqualTo(binds,1)]" in by_sql._jdf.queryExecution().executedPlan().toString()
    assert readers.read_assays(spark, train, schemas.RAW_TRAIN).columns[:4] == ["block1", "block2", "block3", "smiles"]


def test_molecules_and_preview(spark):
    df = readers.molecules(spark, ["CC", "CN", "CO"])
    assert [r["smiles"] for r in df.orderBy("position").collect()] == ["CC", "CN", "CO"]
    assert readers.preview(df, 2).count() == 2
    assert readers.spread_scan(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 8
    assert readers.spread_scan(spark.range(100, numPartitions=20)).rdd.getNumPartitions() == 20


def test_a_scan_with_empty_splits_is_dealt(spark, tmp_path):
    path, settings = str(tmp_path / "t"), {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}
    spark.range(20_000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        scan = spark.read.parquet(path)
        rows = [len(p) for p in readers.spread_scan(scan).rdd.glom().collect()]
        assert scan.rdd.getNumPartitions() > 8 and sum(rows) == 20_000 and max(rows) * 8 <= 2 * 20_000
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_an_uneven_scan_is_spread_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5_000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path).where("id % 5 > 0").select("text")
    spread = readers.spread_scan(scan)
    assert "Exchange" not in spread._jdf.queryExecution().executedPlan().toString() and spread.columns == ["text"]
    parts = [len(p) for p in spread.rdd.glom().collect()]
    assert sum(n > 0 for n in parts) >= 8 and max(parts) * 8 <= 2 * 4_000
    assert sorted(r[0] for r in spread.collect()) == sorted(r[0] for r in scan.collect())
    for other in (scan.distinct(), spark.read.parquet(path).selectExpr("struct(id AS row_index) AS _metadata")):
        assert sorted(map(str, readers.spread_scan(other).collect())) == sorted(map(str, other.collect()))
    assert readers.spread_scan(spark.read.parquet(path).where("id < 0")).collect() == []


def test_a_large_group_of_copies_is_dealt_over_the_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.when(F.col("id") < 2000, "CC").otherwise(F.concat(F.lit("C"), "id")).alias("smiles"),
        F.array(F.lit(0), F.lit(1), F.lit(2)).alias("binds"), F.lit(0).alias("subset"), F.lit("C").alias("smiles_no_linker"))
    path = str(tmp_path / "unified")
    writers.write_unified(rows, path, seed=1, partitions=8)
    written = spark.read.parquet(path)
    assert quality.checksum(written, ["smiles"]).first() == quality.checksum(rows, ["smiles"]).first()
    sizes = written.groupBy(F.input_file_name()).count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 1000


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert session.new_folder(spark, "x").startswith(session.shared_dir(spark))


def test_absent_columns_are_an_error(spark, inputs, tmp_path):
    train = str(inputs / "train.parquet")
    bare = str(tmp_path / "bare.parquet")
    spark.read.parquet(train).drop("binds", "id").write.parquet(bare)
    with pytest.raises(ValueError, match="binds"):
        readers.read_assays(spark, bare, schemas.RAW_TRAIN)
    with pytest.raises(ValueError, match="id"):
        jobs.prepare_dataset(spark, train, bare, str(inputs / "extra.csv"), str(tmp_path / "out"))


def test_labels_survive_without_an_order(spark, inputs, tmp_path):
    train = str(tmp_path / "train.parquet")
    spark.read.parquet(str(inputs / "train.parquet")).drop("id").write.parquet(train)
    df = jobs.prepare_dataset(spark, train, str(inputs / "test.parquet"), str(inputs / "extra.csv"), str(tmp_path / "out"))
    assert [1, 0, 1] in [list(r["binds"]) for r in df.where("subset < 2").collect()]


def test_vocabulary_text_of_several_files_has_unique_ids(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-0.txt").write_text("C\nN\n")
    (tmp_path / "v" / "part-1.txt").write_text("\nO\n")
    rows = readers.import_vocabulary_text(spark, str(tmp_path / "v")).collect()
    assert sorted(map(tuple, rows)) == [("C", 2), ("N", 3), ("O", 4)]
    many = spark.range(5000).select(F.col("id").cast("string").alias("token"), (F.col("id") + 2).cast("int").alias("token_id"))
    writers.export_vocabulary_text(many, str(tmp_path / "many"))
    back = readers.import_vocabulary_text(spark, str(tmp_path / "many"))
    assert back.join(many, ["token", "token_id"]).count() == 5000
