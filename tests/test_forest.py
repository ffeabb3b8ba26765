"""Forests as node tables: compiled scores against the fitted models and against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assayforge.operators import features, forest, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    rows = [(i, x[i].tolist(), "uvwxy"[rng.integers(5)], int(x[i, 0] + x[i, 1] ** 2 + rng.normal() > 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x array<double>, kind string, y int")
    hot = features.one_hot_pipeline("kind", "hot").fit(df).transform(features.add_array_vector(df, "x", "v"))
    indexed = features.assemble(hot, ["v", "hot", "_kind_index"])
    return indexed.repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(table):
    return RandomForestClassifier(labelCol="y", numTrees=12, maxDepth=6, seed=4).fit(table)


def test_compiled_scores_equal_the_model(table, fitted):
    nodes = forest.forest_nodes(fitted)
    assert nodes.where("categories IS NOT NULL").count() and nodes.where("threshold IS NOT NULL").count()
    ours = forest.score_forest(table, forest.Forest.read(nodes), keep=["id"], out="p")
    assert "Python" not in ours._jdf.queryExecution().executedPlan().toString()
    theirs = models.score(table, fitted, keep=["id"], out="q")
    worst = ours.join(theirs, "id").select(F.max(F.abs(F.col("p") - F.col("q"))), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] == 500


def test_sql_equals_the_model(table, fitted):
    sql = forest.Forest.read(forest.forest_nodes(fitted)).sql(lambda i: f"f[{i + 1}]")
    rows = models.score(table.withColumn("f", vector_to_array("features")), fitted,
                        keep=["id", "f"], out="q").toPandas()
    rows["f"] = rows["f"].map(list)
    con = duckdb.connect()
    con.register("rows_of", pd.DataFrame({"id": rows.id, "f": rows.f, "q": rows.q}))
    assert con.execute(f"SELECT max(abs({sql} - q)), count(*) FROM rows_of").fetchone() == (pytest.approx(0, abs=1e-12), 500)




def test_node_table_survives_storage(spark, table, fitted, tmp_path):
    nodes = forest.forest_nodes(fitted)
    nodes.write.parquet(str(tmp_path / "nodes"))
    stored = spark.read.schema(forest.NODES).parquet(str(tmp_path / "nodes"))
    assert forest.Forest.read(stored) == forest.Forest.read(nodes)


def test_one_tree(table):
    tree = DecisionTreeClassifier(labelCol="y", maxDepth=4, seed=1).fit(table)
    ours = forest.score_forest(table, forest.Forest.read(forest.forest_nodes(tree)), keep=["id"], out="p")
    theirs = models.score(table, tree, keep=["id"], out="q")
    assert ours.join(theirs, "id").where("abs(p - q) > 1e-12").count() == 0


def test_missing_values_go_right_and_bad_tables_raise(spark):
    rows = [(0, 0, 0, 0.5, None, 1, 2, 0.4), (0, 1, None, None, None, None, None, 0.1), (0, 2, None, None, None, None, None, 0.9)]
    made = forest.Forest.read(spark.createDataFrame(rows, forest.NODES))
    df = spark.createDataFrame([(1, [0.5]), (2, [0.6]), (3, [None]), (4, []), (5, [float("nan")]), (6, None)], "id int, f array<double>")
    got = {r["id"]: r["p"] for r in forest.score_forest(df, made, features="f", keep=["id"], out="p").collect()}
    assert got == {1: 0.1, 2: 0.9, 3: 0.9, 4: 0.9, 5: 0.9, 6: 0.9}
    with pytest.raises(ValueError, match="child"):
        forest.Forest.read(spark.createDataFrame(rows[:2], forest.NODES))
    with pytest.raises(ValueError, match="twice"):
        forest.Forest.read(spark.createDataFrame([*rows, rows[1]], forest.NODES))
    with pytest.raises(ValueError, match="more than 2 nodes"):
        forest.Forest.read(spark.createDataFrame(rows, forest.NODES), most_nodes=2)
