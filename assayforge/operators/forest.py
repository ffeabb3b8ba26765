"""Forests as data: a table of nodes, compiled to column expressions and to SQL.

A fitted forest becomes rows (tree, node, feature, threshold, categories, left, right, probability). Scoring from
them is a nested CASE a tree inside the row's own projection, so neither a model object nor a Python worker is
needed where rows are scored, and any engine that reads the table or the SQL gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.session import new_folder

MOST_NODES = 200_000  # of a forest that is compiled: it travels with the plan
NODES = ("tree int, node int, feature int, threshold double, categories array<double>, left int, right int, "
         "probability double")


def forest_nodes(model: Model) -> DataFrame:
    """The node table of a fitted forest or tree classifier, read back from where the model is written.

    A split on a threshold sends values up to it to ``left``; one on ``categories`` those among them. Leaves have
    no children; ``probability`` is the share of class 1 among a node's training rows.
    """
    spark = SparkSession.active()
    folder = new_folder(spark, "forest")
    model.write().overwrite().save(folder)
    rows = spark.read.parquet(f"{folder}/data")
    tree = F.col("treeID") if "treeID" in rows.columns else F.lit(0)
    node = F.col("nodeData") if "nodeData" in rows.columns else F.struct(*rows.columns)
    flat = rows.select(tree.cast("int").alias("tree"), node.alias("n")).select("tree", "n.*")
    inner, ordered = F.col("leftChild") >= 0, F.col("split.numCategories") < 0
    values, stats = F.col("split.leftCategoriesOrThreshold"), F.col("impurityStats")
    return flat.select(
        "tree", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ordered, F.get(values, 0)).alias("threshold"), F.when(inner & ~ordered, values).alias("categories"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        (F.get(stats, 1) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)).alias("probability"))


@dataclass(frozen=True)
class Node:
    feature: int | None
    threshold: float | None
    categories: tuple[float, ...] | None
    left: int | None
    right: int | None
    probability: float | None


@dataclass(frozen=True)
class Forest:
    """Trees, each a dictionary of nodes by number; node 0 is the root."""

    trees: tuple[dict[int, Node], ...]

    @staticmethod
    def read(nodes: DataFrame, most_nodes: int = MOST_NODES) -> Forest:
        """From a node table. More than ``most_nodes`` nodes raise; an unknown child or a leaf without probability too."""
        rows = nodes.select("tree", "node", "feature", "threshold", "categories", "left", "right", "probability").limit(most_nodes + 1).collect()
        if len(rows) > most_nodes:
            raise ValueError(f"a forest of more than {most_nodes} nodes")
        trees: dict[int, dict[int, Node]] = {}
        for tree, node, feature, threshold, categories, left, right, probability in rows:
            held = trees.setdefault(tree, {})
            if node in held:
                raise ValueError(f"node {node} of tree {tree} occurs twice")
            held[node] = Node(feature, threshold, None if categories is None else tuple(categories), left, right, probability)
        for tree, held in trees.items():
            ends = {child for n in held.values() if n.left is not None for child in (n.left, n.right)}
            leaves = [n for n in held.values() if n.left is None]
            if 0 not in held or not ends <= held.keys() or any(n.probability is None for n in leaves):
                raise ValueError(f"tree {tree} lacks its root, a child or a leaf's probability")
        return Forest(tuple(held for _, held in sorted(trees.items())))

    def columns(self, feature: Callable[[int], Column]) -> list[Column]:
        """The probability by each tree, where ``feature`` gives the column of a feature number. Null goes right."""
        def below(tree: dict[int, Node], at: int) -> Column:
            node = tree[at]
            if node.left is None:
                return F.lit(float(node.probability))
            value = feature(node.feature)
            goes_left = value <= F.lit(node.threshold) if node.categories is None else value.isin(*node.categories)
            return F.when(goes_left, below(tree, node.left)).otherwise(below(tree, node.right))

        return [below(tree, 0) for tree in self.trees]

    def sql(self, feature: Callable[[int], str]) -> str:
        """The mean over the trees as SQL text, where ``feature`` gives the SQL of a feature number."""
        number = lambda x: f"{x:.17e}"  # noqa: E731  an exponent makes it a double

        def below(tree: dict[int, Node], at: int) -> str:
            node = tree[at]
            if node.left is None:
                return number(node.probability)
            listed = None if node.categories is None else ", ".join(map(number, node.categories))
            value = feature(node.feature)
            goes_left = f"{value} <= {number(node.threshold)}" if listed is None else f"{value} IN ({listed})"
            return f"CASE WHEN {goes_left} THEN {below(tree, node.left)} ELSE {below(tree, node.right)} END"

        return f"(({' + '.join(f'({below(tree, 0)})' for tree in self.trees)}) / {number(len(self.trees))})"


def score_forest(df: DataFrame, forest: Forest, *, features: str = "features", keep: Sequence[str], out: str = "binds") -> DataFrame:
    """``keep`` columns and the mean class-1 probability of the trees, from a vector or an array of features.

    Equal to what the fitted model gives. Row-local, inside the JVM; the array is worked out once a row.
    """
    column = F.col(features)
    array = vector_to_array(column) if isinstance(df.schema[features].dataType, VectorUDT) else column.cast("array<double>")
    held = fresh("_features", df)
    rows = df.select(*keep, array.alias(held))
    trees = forest.columns(lambda i: F.get(F.col(held), i))
    total = F.aggregate(F.array(*trees), F.lit(0.0), lambda a, b: a + b)
    return rows.select(*keep, (total / len(trees)).alias(out))
