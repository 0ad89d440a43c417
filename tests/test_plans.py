from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from coppice.operators.metadata import build
from coppice.plans.local import fit
from coppice.plans.schedule import Bin, Task, local_rows, memory_bytes, pack
from coppice.plans.tree import Tree


def tasks(*rows):
    return [Task(0, i, r, 0.0) for i, r in enumerate(rows)]


def test_pack_by_memory():
    bins = pack(tasks(2, 2, 2, 9), 10)
    assert sorted(len(b.tasks) for b in bins) == [1, 3]
    assert [b.rows for b in bins] == [9, 6]


def test_pack_by_count():
    assert sorted(len(b.tasks) for b in pack(tasks(2, 2, 2), 100, 2)) == [1, 2]


def test_pack_orders_by_predicted_time():
    bins = pack([Task(0, 0, 5, 1.0), Task(0, 1, 4, 100.0)], 5, time=lambda rows, impurity: impurity)
    assert [b.tasks[0].node for b in bins] == [1, 0]


def test_pack_rejects_what_fits_nowhere():
    with pytest.raises(ValueError, match="doesn't fit"):
        pack(tasks(11), 10)
    assert not Bin(10, 1).fit(Task(0, 0, 11, 0.0))


def test_memory():
    assert memory_bytes("4g") == 4 << 30
    assert memory_bytes("512m") == 512 << 20
    assert memory_bytes("1024") == 1024
    meta = replace(build(3, 100, 2, None, "gini", True), num_splits=(3, 3, 3))
    assert local_rows(10_000, 2, meta, 4) == int((5_000 - 3 * 4 * 2 * 8) / (4 * 8 * 5))
    assert local_rows(10, 2, meta, 4) == 0


def leaf(prediction, impurity=0.0):
    t = Tree()
    t.add(prediction, impurity)
    return t


def inner(left, right, prediction=0.0, impurity=0.5, feature=0, threshold=0.5):
    t = Tree()
    t.add(prediction, impurity, 0.1)
    t.feature[0], t.threshold[0], t.bin[0] = feature, threshold, 0
    for side, sub in (("left", left), ("right", right)):
        at = t.add(0.0, 0.0)
        getattr(t, side)[0] = at
        t.graft(at, sub)
    return t


def test_prune():
    t = inner(inner(leaf(1.0), leaf(1.0), 1.0, 0.3), inner(leaf(0.0), leaf(1.0)))
    assert (len(t), len(t.pruned())) == (7, 5)
    assert t.pruned().impurity[1] == 0.3
    all_same = inner(inner(leaf(1.0), leaf(1.0)), leaf(1.0))
    assert len(all_same.pruned()) == 1
    assert len(inner(leaf(0.0), leaf(1.0)).pruned()) == 3


def test_shape_and_text():
    t = inner(leaf(2.0), inner(leaf(3.0), leaf(4.0), feature=2, threshold=7.0))
    assert (len(t), t.depth(), t.num_descendants(), t.max_feature()) == (5, 2, 4, 2)
    assert "If (feature 0 <= 0.5)" in t.describe() and "Else (feature 2 > 7.0)" in t.describe()
    assert t.same(t.copy()) and not t.same(leaf(1.0))
    x = np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 7.0], [1.0, 0.0, 8.0]])
    assert t.flat().predict(x).tolist() == [2.0, 3.0, 4.0]


def test_categorical_walk():
    t = inner(leaf(1.0), leaf(2.0))
    t.categories[0], t.arity[0] = (0, 2), 3
    assert t.flat().predict(np.array([[0.0], [1.0], [2.0]])).tolist() == [1.0, 2.0, 1.0]


@pytest.mark.parametrize("depth", [10, 40, 200])
def test_deep_local_trees(depth):
    bins = np.ones((depth + 1, depth), np.int64)
    bins[np.arange(depth), np.arange(depth)] = 0
    labels = np.zeros(depth + 1)
    labels[-1] = 1
    meta = replace(build(depth, depth + 1, 2, None, "gini", True, max_depth=depth), num_splits=(1,) * depth)
    tree = fit(bins, labels, np.ones(depth + 1), meta, [[0.5]] * depth, depth)
    assert tree.depth() == depth
    assert tree.flat().leaves(bins, True).shape == (depth + 1,)
    assert (tree.flat().predict(bins.astype(float)) == labels).all()


def test_local_constant():
    meta = replace(build(1, 8, 2, None, "gini", True), num_splits=(0,))
    tree = fit(np.zeros((8, 1), np.int64), np.ones(8), np.ones(8), meta, [[]], 5)
    assert (len(tree), tree.prediction[0], tree.impurity[0]) == (1, 1.0, -1.0)


def test_zero_gain_is_a_choice():
    bins = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    meta = replace(build(2, 4, 2, None, "gini", True), num_splits=(1, 1))
    assert len(fit(bins, labels, np.ones(4), meta, [[0.5], [0.5]], 3)) == 1
    free = replace(meta, zero_gain=True)
    tree = fit(bins, labels, np.ones(4), free, [[0.5], [0.5]], 3)
    assert (tree.flat().predict(bins.astype(float)) == labels).all()


def test_local_rows_follow_the_memory_outside_the_heap():
    from coppice.plans.schedule import PYTHON_MEMORY, python_bytes

    conf = lambda *values: dict(zip(PYTHON_MEMORY, values))
    assert python_bytes(conf("2g", "1g", None, "8g"), 1) == 2 << 30
    assert python_bytes(conf(None, "1024", None, "8g"), 1) == 1 << 30
    assert python_bytes(conf(None, None, "0.5", "8g"), 1) == 4 << 30
    assert python_bytes(conf(None, None, None, "1g"), 1) == 384 << 20
    assert python_bytes(conf(None, None, None, None), 7) == 7
