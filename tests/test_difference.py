"""Checksum trees: changed keys against a full comparison, and what is read to find them."""

import random

import pytest
from pyspark.sql import functions as F

from assayforge.operators import difference

SCHEMA = "id long, part string, text string, x double"


def table(n):
    rng = random.Random(4)
    return [(i, f"p{i % 7}", rng.choice(["a", "b", "", None]), rng.choice([0.5, None, 2.0])) for i in range(n)]


def compare(one, two):
    def grouped(rows):
        out = {}
        for r in rows:
            out.setdefault(r[:2], []).append(str(r))
        return {k: sorted(v) for k, v in out.items()}
    a, b = grouped(one), grouped(two)
    return sorted([(*k, "removed" if k not in b else "added" if k not in a else "changed") for k in a.keys() | b.keys()
                   if a.get(k) != b.get(k)], key=str)


def found(spark, tmp_path, one, two, **options):
    for name, rows in (("one", one), ("two", two)):
        difference.write_tree(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / name), ["id", "part"])
    got = difference.changed_keys(spark, str(tmp_path / "one"), str(tmp_path / "two"), **options)
    assert got.columns == ["id", "part", "change"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture()
def small_leaves(monkeypatch):
    monkeypatch.setattr(difference, "ROWS_PER_LEAF", 4)


def test_changes_are_found(spark, tmp_path, small_leaves):
    one = table(3000)
    two = [r for r in one if r[0] % 501] + [(9000 + i, "new", None, 1.0) for i in range(3)]
    two = [(*r[:2], (r[2] or "") + "!", r[3]) if r[0] % 700 == 1 else r for r in two]
    two = [(*r[:2], "" if r[2] is None else r[2], r[3]) if r[0] == 42 else r for r in two] + [one[5], one[5]]
    random.Random(1).shuffle(two)
    assert found(spark, tmp_path, one, two) == compare(one, two)
    branches, levels = difference.unequal_branches(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert levels == 4 and all(len(b) == 3 for b in branches) and len(branches) <= 20  # of 4,096
    rows = spark.read.parquet(str(tmp_path / "one" / "rows"))
    assert rows.where(difference._below(branches)).count() < 100
    plan = rows.where(difference._below(branches))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "StringStartsWith(branch" in plan


@pytest.mark.parametrize("most", [1, 20, 512])
def test_many_changes_end_the_walk_earlier(spark, tmp_path, small_leaves, most):
    one = table(800)
    two = [(*r[:3], 7.0) if r[0] % 3 == 0 else r for r in one]
    assert found(spark, tmp_path, one, two, most=most) == compare(one, two)


def test_equal_tables_are_told_by_the_root(spark, tmp_path, small_leaves):
    rows = table(500)
    assert found(spark, tmp_path, rows, rows[::-1]) == []
    assert difference.unequal_branches(spark, str(tmp_path / "one"), str(tmp_path / "two")) == ([], 1)


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (3000, 10)])
def test_empty_and_unlike_sizes(spark, tmp_path, small_leaves, sizes):
    one, two = (table(n) for n in sizes)
    assert found(spark, tmp_path, one, two) == compare(one, two)


def test_null_keys_and_one_hot_key(spark, tmp_path, small_leaves):
    one = [(None, None, "a", 1.0)] * 40 + [(1, None, "b", None)] + [(7, "hot", f"t{i}", 1.0) for i in range(900)]
    two = [(None, None, "a", 1.0)] * 39 + [(1, None, "b", None)] + [(7, "hot", f"t{i}", 1.0) for i in range(900)]
    assert found(spark, tmp_path, one, two) == [(None, None, "changed")]
    assert spark.read.parquet(str(tmp_path / "one" / "rows")).select(F.countDistinct("branch")).first()[0] == 3
