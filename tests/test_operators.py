from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions.impurity import FARTHEST, centroids, impurity_of, predict_of
from coppice.operators import bagging, binning
from coppice.operators.metadata import build, features_per_node, most_unordered, unordered_bins
from coppice.operators.search import best_split, feature_split
from coppice.operators.splits import find_thresholds, sample_share, subset, thresholds, unordered_subsets


def counted(values):
    keys = sorted(set(values))
    return keys, [values.count(k) for k in keys]


@pytest.mark.parametrize(
    ("values", "bins", "expected"),
    [
        ([0, 1, 0, 0, 1, 0, 1, 1], 3, [0.5]),
        ([0, 0, 1, 1, 2, 2, 3, 3], 3, [0.5, 2.5]),
        ([1] * 2 + [2] * 8 + [3] * 2, 5, [1.5, 2.5]),
        ([2] * 15 + [3, 4, 5], 3, [2.5, 3.5]),
        ([1] + [2] * 15, 2, [1.5]),
        ([7] * 5, 4, []),
    ],
)
def test_thresholds(values, bins, expected):
    assert thresholds(*counted(values), bins - 1) == expected


def test_unordered_subsets():
    assert [sorted(s) for s in unordered_subsets(3)] == [[0], [1], [0, 1]]
    assert subset(13, 10) == [3, 2, 0]
    assert unordered_bins(5) == 15
    assert most_unordered(32) == 5


@pytest.mark.parametrize(("strategy", "expected"), [("all", 50), ("sqrt", 8), ("log2", 6), ("onethird", 17), ("0.1", 5), ("0.10", 5), ("1.0", 50), ("0.001", 1), ("7", 7), ("80", 50)])
def test_features_per_node(strategy, expected):
    assert features_per_node(strategy, 50, 3, True) == expected


@pytest.mark.parametrize("strategy", ["0", "1.1", "-.1", "half", "-3"])
def test_features_per_node_rejects(strategy):
    with pytest.raises(ValueError):
        features_per_node(strategy, 50, 3, True)


def test_auto_features():
    assert features_per_node("auto", 9, 1, True) == 9
    assert features_per_node("auto", 9, 2, True) == 3
    assert features_per_node("auto", 9, 2, False) == 3


def test_metadata_kinds():
    meta = build(3, 1000, 3, {0: 3, 1: 20, 2: 1}, "gini", True)
    assert meta.unordered == {0}
    assert meta.is_continuous(2)
    assert build(2, 1000, 2, {0: 3}, "gini", True).unordered == frozenset()
    assert build(1, 10, 2, None, "gini", True, 32).max_bins == 10
    with pytest.raises(ValueError, match="categories"):
        build(1, 1000, 2, {0: 40}, "gini", True)
    with pytest.raises(ValueError, match="impurity"):
        build(1, 10, 2, None, "variance", True)


def test_impurities():
    s = np.array([[2.0, 2.0], [4.0, 0.0], [0.0, 0.0]])
    assert impurity_of(s, "gini").tolist() == [0.5, 0.0, 0.0]
    assert impurity_of(s, "entropy").tolist() == [1.0, 0.0, 0.0]
    y = np.array([1.0, 2.0, 4.0])
    stats = np.array([3.0, y.sum(), (y * y).sum()])
    assert math.isclose(float(impurity_of(stats, "variance")), y.var())
    assert predict_of(np.array([1.0, 2.0, 2.0]), "gini") == 1
    assert predict_of(stats, "variance") == y.mean()


def test_centroids():
    assert centroids(np.array([[1.0, 3.0], [0.0, 0.0], [5.0, 2.0]]), "gini").tolist() == [3.0, FARTHEST, 2.0]
    assert centroids(np.array([[2.0, 6.0, 20.0], [0.0, 0.0, 0.0]]), "variance").tolist() == [3.0, FARTHEST]
    assert centroids(np.array([[1.0, 1.0, 0.0]]), "gini").tolist() == [0.5]


def meta_of(num_classes=2, categorical=None, splits=(3,), impurity="gini", features=1, **limits):
    from dataclasses import replace

    return replace(build(features, 100, num_classes, categorical, impurity, impurity != "variance", **limits), num_splits=splits)


def test_continuous_split():
    cells = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    found = feature_split(cells, 0, meta_of())
    assert (found.split.bin, found.gain, found.left.tolist()) == (1, 0.5, [2.0, 0.0])


@pytest.mark.parametrize(("labels", "left"), [([0, 0, 1, 1, 1, 1, 1], (0,)), ([0, 0, 0, 1, 1, 1, 1], (0, 1))])
def test_ordered_categorical_split(labels, left):
    values = [0, 0, 1, 2, 2, 2, 2]
    cells = np.zeros((3, 2))
    for v, y in zip(values, labels):
        cells[v, y] += 1
    assert feature_split(cells, 0, meta_of(categorical={0: 3}, splits=(0,))).split.left == left


def test_unordered_split():
    cells = np.array([[5.0, 0, 0], [0, 5.0, 0], [5.0, 0, 0]])
    found = feature_split(cells, 0, meta_of(3, {0: 3}, (0,)))
    assert found.split.left == (1,)


def test_first_feature_wins_ties():
    cells = np.array([[1.0, 0.0], [0.0, 1.0]])
    meta = meta_of(splits=(1, 1), features=2)
    assert best_split([cells, cells], [1, 0], meta).split.feature == 1
    assert best_split([cells, cells], [0, 1], meta).split.feature == 0


def test_no_split():
    meta = meta_of(splits=(0,))
    assert not best_split([np.array([[2.0, 3.0]])], [0], meta).valid
    heavy = meta_of(splits=(1,), min_instances=2)
    assert not best_split([np.array([[1.0, 0.0], [0.0, 3.0]])], [0], heavy).valid
    gainful = meta_of(splits=(1,), min_gain=0.6)
    assert not best_split([np.array([[2.0, 0.0], [0.0, 2.0]])], [0], gainful).valid


def test_binning(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,), (2.5,), (9.0,), (float("nan"),)], "v double")
    got = [r["b"] for r in df.select(binning.bin_of(F.col("v"), [0.5, 2.5]).alias("b")).collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_category_out_of_range(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    with pytest.raises(Exception, match="3 categories"):
        df.select(binning.category_of(F.col("v"), 3, 0).alias("b")).collect()


def test_find_thresholds(spark):
    rows = [([float(i % 4), float(i)],) for i in range(200)]
    df = spark.createDataFrame(rows, "features array<double>")
    meta = build(2, 200, 2, None, "gini", True, 8)
    cuts = find_thresholds(df, meta, 1)
    assert cuts[0] == [0.5, 1.5, 2.5]
    assert cuts[1] == thresholds([float(i) for i in range(200)], [1] * 200, 7)
    assert find_thresholds(df, meta, 1, custom=[[2.0, 1.0], [5.0]]) == [[1.0, 2.0], [5.0]]
    with pytest.raises(ValueError, match="custom splits"):
        find_thresholds(df, meta, 1, custom=[[1.0]])


def test_sample_share():
    assert sample_share(5_000, 32) == 1.0
    assert sample_share(100_000, 32) == 0.1
    assert sample_share(1_000_000, 200) == 0.04


def test_bags(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    bagged = bagging.bag(df, 3, 0.7, 5)
    w = np.array([r["bag"] for r in bagged.orderBy("row_id").collect()])
    assert np.allclose(w.mean(0), 0.7, atol=0.03)
    assert np.allclose(w.var(0), 0.7, atol=0.04)
    again = np.array([r["bag"] for r in bagging.bag(df.repartition(7), 3, 0.7, 5).orderBy("row_id").collect()])
    assert (w == again).all()
    one = np.array([r["bag"][0] for r in bagging.bag(df, 1, 0.5, 5).collect()])
    assert set(one) == {0.0, 1.0} and abs(one.mean() - 0.5) < 0.02
    assert {r["bag"][0] for r in bagging.bag(df, 1, 1.0, 5).collect()} == {1.0}
