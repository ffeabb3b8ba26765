"""Line numbers of text files that are read in many splits, against a plain read."""

import gzip
import random

import pytest

from assayforge.sources import readers

TEXT = "one\r\ntwo\n\n  \t\nthree words\r\n\r\nfour\n é漢字 \rfive\n" + "x" * 90 + "\n\n\nsix"


@pytest.fixture()
def splits_of(spark):
    """Sets how many bytes a split has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def set_size(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_size
    for name in names:
        spark.conf.unset(name)


def plain(*texts):
    """All lines in order, as universal newlines cut them."""
    lines = []
    for text in texts:
        parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines += parts[:-1] if parts[-1] == "" else parts
    return lines


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 16, 40, 1000])
def test_one_file_in_many_splits(spark, tmp_path, splits_of, size):
    (tmp_path / "v.txt").write_bytes(TEXT.encode())
    splits_of(size)
    lines = readers.ordered_lines(spark, str(tmp_path / "v.txt")).orderBy("position").collect()
    assert [r["value"] for r in lines] == plain(TEXT)
    assert [r["position"] for r in lines] == list(range(len(lines)))
    vocab = readers.import_vocabulary_text(spark, str(tmp_path / "v.txt")).orderBy("token_id").collect()
    kept = [t.strip() for t in plain(TEXT) if t.strip()]
    assert [tuple(r) for r in vocab] == [(t, i + 2) for i, t in enumerate(kept)]


def test_several_files_one_of_them_packed(spark, tmp_path, splits_of):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["a", "", "bb", "c c"]) for _ in range(200)) for _ in range(3)]
    for name, text in zip(("a.txt", "c.txt"), (texts[0], texts[2])):
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "b.txt.gz", "wt") as file:
        file.write(texts[1])
    splits_of(64)
    lines = readers.ordered_lines(spark, str(tmp_path))
    assert lines.select("file").distinct().count() == 3
    assert [r["value"] for r in lines.orderBy("position").collect()] == plain(*texts)


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    assert readers.ordered_lines(spark, str(tmp_path / "none.txt")).collect() == []
    with pytest.raises(FileNotFoundError):
        readers.ordered_lines(spark, str(tmp_path / "absent.txt"))
