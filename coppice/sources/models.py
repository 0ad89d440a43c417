"""Stored forests: Parquet tables of nodes and of trees beside a JSON line of settings."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.tree import Tree

NODES = (
    "treeID int, nodeData struct<id:int, prediction:double, impurity:double, gain:double, leftChild:int, rightChild:int,"
    " split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>"
)


def node_rows(trees: list[Tree]) -> list[tuple]:
    """Pre-order rows of all trees; a leaf has children -1 and a split of feature -1."""
    rows = []
    for t, tree in enumerate(trees):
        tree = tree.copy()
        for i in range(len(tree)):
            if tree.is_leaf(i):
                split = (-1, [], -1)
            elif tree.categories[i] is None:
                split = (tree.feature[i], [tree.threshold[i]], -1)
            else:
                split = (tree.feature[i], [float(c) for c in sorted(tree.categories[i])], tree.arity[i])
            rows.append((t, (i, tree.prediction[i], tree.impurity[i], tree.gain[i], tree.left[i], tree.right[i], split)))
    return rows


def node_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    return spark.createDataFrame(node_rows(trees), NODES)


def trees_of(table: DataFrame) -> list[Tree]:
    """Trees from their node rows; node ids of a tree must be 0, 1, ..."""
    found: dict[int, list] = {}
    for r in table.orderBy("treeID", "nodeData.id").collect():
        found.setdefault(r["treeID"], []).append(r["nodeData"])
    trees = []
    for t in sorted(found):
        tree = Tree()
        for i, n in enumerate(found[t]):
            if n["id"] != i:
                raise ValueError(f"tree {t}: expected node {i}, found {n['id']}")
            tree.add(n["prediction"], n["impurity"], n["gain"])
            split = n["split"]
            if split["featureIndex"] >= 0:
                tree.feature[i], tree.left[i], tree.right[i] = split["featureIndex"], n["leftChild"], n["rightChild"]
                if split["numCategories"] < 0:
                    tree.threshold[i] = split["leftCategoriesOrThreshold"][0]
                else:
                    tree.categories[i] = tuple(int(c) for c in split["leftCategoriesOrThreshold"])
                    tree.arity[i] = split["numCategories"]
        trees.append(tree)
    return trees


def save(spark: SparkSession, path: str, trees: list[Tree], settings: dict[str, Any], overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode(mode).text(f"{path}/metadata")
    node_table(spark, trees).write.mode(mode).parquet(f"{path}/data")
    weights = [(t, 1.0, len(tree)) for t, tree in enumerate(trees)]
    spark.createDataFrame(weights, "treeID int, weight double, numNodes int").write.mode(mode).parquet(f"{path}/treesMetadata")


def load(spark: SparkSession, path: str) -> tuple[list[Tree], dict[str, Any]]:
    settings = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    trees = trees_of(spark.read.parquet(f"{path}/data"))
    expected = {r["treeID"]: r["numNodes"] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    if expected != {t: len(tree) for t, tree in enumerate(trees)}:
        raise ValueError(f"{path}: trees and their metadata don't match")
    return trees, settings


def tree_sizes(table: DataFrame) -> DataFrame:
    """treeID, num_nodes, num_leaves of a node table."""
    leaf = F.when(F.col("nodeData.leftChild") < 0, 1).otherwise(0)
    return table.groupBy("treeID").agg(F.count("*").alias("num_nodes"), F.sum(leaf).alias("num_leaves"))
