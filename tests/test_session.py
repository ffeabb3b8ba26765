"""Folders for intermediates: below the shared one, removed with their block."""

from pathlib import Path

import pytest

from assayforge import session
from assayforge.operators import difference


def test_scratch_removes_intermediates(spark):
    with session.scratch(spark) as folder:
        inner = session.new_folder(spark, "x")
        assert inner.startswith(f"{folder}/")
        spark.range(5).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 5
        with session.scratch(spark) as nested:
            assert nested.startswith(f"{folder}/")
            spark.range(3).write.parquet(session.new_folder(spark, "y"))
        assert not Path(nested).exists() and Path(inner).exists()
    assert not Path(folder).exists()
    assert not session.new_folder(spark, "x").startswith(f"{folder}/")


def test_scratch_ends_after_an_error(spark):
    with pytest.raises(RuntimeError, match="inside"):
        with session.scratch(spark) as folder:
            spark.range(3).write.parquet(f"{folder}/a")
            raise RuntimeError("inside")
    assert not Path(folder).exists()


def test_a_job_leaves_its_result_only(spark, tmp_path):
    before = set(Path(session.shared_dir(spark)).iterdir())
    with session.scratch(spark):
        trees = [session.new_folder(spark, name) for name in ("one", "two")]
        difference.write_tree(spark.range(50), trees[0], ["id"])
        difference.write_tree(spark.range(49), trees[1], ["id"])
        difference.changed_keys(spark, *trees).write.parquet(str(tmp_path / "changes"))
    assert spark.read.parquet(str(tmp_path / "changes")).collect() == [(49, "removed")]
    assert {p.name.split("-")[0] for p in set(Path(session.shared_dir(spark)).iterdir()) - before} <= {"rdd"}


def test_only_own_folders_are_removed(spark, tmp_path):
    with pytest.raises(ValueError, match="not below"):
        session.remove_folder(spark, str(tmp_path))
    assert tmp_path.exists()
