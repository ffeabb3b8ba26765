"""Appended CSV: header once, batches once, attempts that broke off unseen."""

import csv

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.streaming import csv_log, incremental

IN = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
OUT = T.StructType([*IN, T.StructField("size", T.IntegerType())])
TEXTS = ["plain", 'quo"te', "a,b", "", None, "  spaced ", "é漢", "#x", "back\\slash", "'", '"', '""', "a\\"]


@pytest.fixture()
def arriving(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, first, last):
        rows = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(first, last)], IN)
        rows.coalesce(1).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(tmp_path / name))
        for part in (tmp_path / name).glob("*.csv"):
            part.rename(folder / f"{name}.csv")

    return folder, add


def scored(batch):
    return batch.withColumn("size", F.length("text"))


def run(spark, tmp_path, transform=scored):
    stream = incremental.stream_csv(spark, str(tmp_path / "in"), IN, files_per_trigger=1)
    csv_log.append_csv(stream, str(tmp_path / "out"), str(tmp_path / "check"), transform).awaitTermination()


def rows_of(spark, tmp_path):
    return sorted(map(str, csv_log.read_csv_log(spark, str(tmp_path / "out"), OUT).collect()))


def expected(n):
    """An empty text is null in CSV."""
    texts = [(i, TEXTS[i % len(TEXTS)] or None) for i in range(n)]
    return sorted(str(T.Row(id=i, text=t, size=None if t is None else len(t))) for i, t in texts)


def test_two_runs_and_a_repeat_equal_one_run(spark, tmp_path, arriving):
    folder, add = arriving
    add("one", 0, 20)
    add("two", 20, 30)
    run(spark, tmp_path)
    add("three", 30, 41)
    run(spark, tmp_path)
    for name in ("2", ".2.crc"):  # as if the last batch had failed after its commit to the log
        (tmp_path / "check" / "commits" / name).unlink()
    run(spark, tmp_path)
    assert rows_of(spark, tmp_path) == expected(41)
    assert csv_log.commits(spark, str(tmp_path / "out")).count() == 3
    assert csv_log.check_log(spark, str(tmp_path / "out"), OUT).count() == 0
    files = sorted((tmp_path / "out" / "data").glob("*/*.csv"))
    text = "".join(f.read_text() for f in files)
    assert text.startswith("id,text,size\n") and text.count("id,text,size") == 1
    (tmp_path / "whole.csv").write_text(text)
    whole = spark.read.schema(OUT).options(**csv_log.FORMAT).option("header", True).csv(str(tmp_path / "whole.csv"))
    assert sorted(map(str, whole.collect())) == expected(41)
    with open(tmp_path / "whole.csv", newline="") as file:  # and by another reader
        other = list(csv.reader(file))
    assert sorted(str(T.Row(id=int(i), text=t or None, size=int(n) if n else None)) for i, t, n in other[1:]) == expected(41)


def test_an_attempt_that_broke_off_is_not_seen(spark, tmp_path, arriving):
    folder, add = arriving
    add("one", 0, 10)
    run(spark, tmp_path)
    add("two", 10, 20)

    def broken(batch):
        return scored(batch).withColumn("size", F.when(F.col("id") == 19, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("size")))

    with pytest.raises(Exception, match="broken"):
        run(spark, tmp_path, broken)
    assert rows_of(spark, tmp_path) == expected(10)
    run(spark, tmp_path)
    assert rows_of(spark, tmp_path) == expected(20)


def test_lost_lines_are_found_and_nothing_gives_nothing(spark, tmp_path, arriving):
    out = str(tmp_path / "out")
    assert csv_log.read_csv_log(spark, out, OUT).collect() == []
    df = spark.createDataFrame([(1, "a\nb", 3), (2, "c", 1)], OUT)
    csv_log.write_batch(df.coalesce(1), out, "q", 0)
    assert csv_log.read_csv_log(spark, out, OUT, multiline=True).count() == 2
    assert csv_log.check_log(spark, out, OUT, multiline=True).count() == 0
    for part in (tmp_path / "out" / "data" / "q-0000000000").glob("*.csv"):
        part.write_text("2,c,1\n")
        (part.parent / f".{part.name}.crc").unlink()
    assert [tuple(r) for r in csv_log.check_log(spark, out, OUT).collect()] == [("q", 0, 2, 1)]
