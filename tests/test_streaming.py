import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from assayforge.functions.sequences import tokenize
from assayforge.operators import features, models, vocabulary
from assayforge.streaming import incremental


@pytest.fixture()
def arriving(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, first, last):
        rows = spark.range(first, last).select(
            "id", F.when(F.col("id") % 2 == 0, "CC[Dy]").otherwise("CN").alias("smiles"), (F.col("id") % 10).alias("v"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        for part in (tmp_path / name).glob("*.parquet"):
            part.rename(folder / f"{name}.parquet")

    return folder, add


def test_scores_appended_once_equal_the_batch(spark, tmp_path, arriving):
    folder, add = arriving
    add("one", 0, 100)
    batch = spark.read.parquet(str(folder)).withColumn("y", (F.col("v") > 4).cast("int"))
    model = Pipeline(stages=[features.assembler(["v"]), models.random_forest(label="y", trees=5)]).fit(batch)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = incremental.stream_parquet(spark, str(folder), batch.drop("y").schema, files_per_trigger=1)
        incremental.score_stream(stream, model, out, checkpoint, keep=["id"]).awaitTermination()

    run()
    add("two", 100, 150)
    run()
    run()
    got = incremental.read_appended(spark, out)
    assert got.count() == 150
    expected = models.score(spark.read.parquet(str(folder)), model, keep=["id"])
    assert sorted(map(tuple, got.select("id", "binds").collect())) == sorted(map(tuple, expected.collect()))


def test_prepared_rows_equal_the_batch(spark, tmp_path, arriving):
    folder, add = arriving
    add("one", 0, 20)
    add("two", 20, 30)
    df = spark.read.parquet(str(folder))
    vocab = vocabulary.build_vocabulary(df.select(tokenize(F.col("smiles")).alias("t")), "t")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    stream = incremental.stream_parquet(spark, str(folder), df.schema, files_per_trigger=1)
    incremental.prepare_stream(stream, "smiles", vocab, out, checkpoint).awaitTermination()
    got = incremental.read_appended(spark, out)
    expected = incremental.prepare(df, "smiles", vocab)
    columns = ["id", "clean", "ids"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_a_repeated_batch_replaces_its_first_attempt(spark, tmp_path, arriving):
    folder, add = arriving
    add("one", 0, 10)
    out = str(tmp_path / "out")
    schema = spark.read.parquet(str(folder)).schema

    def run(checkpoint):
        stream = incremental.stream_parquet(spark, str(folder), schema)
        incremental.append_once(stream, out, str(tmp_path / checkpoint)).awaitTermination()

    run("first")
    for commit in (tmp_path / "first" / "commits").iterdir():  # as if the batch had failed after writing
        commit.unlink()
    run("first")
    assert incremental.read_appended(spark, out).count() == 10
    run("second")  # another query adds its rows
    assert incremental.read_appended(spark, out).count() == 20


def test_csv_stream(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,smiles\n1,CC\n2,CN\n")
    stream = incremental.stream_csv(spark, str(folder), spark.createDataFrame([], "id long, smiles string").schema)
    out = str(tmp_path / "out")
    incremental.append_once(stream, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in incremental.read_appended(spark, out).collect()) == [1, 2]
