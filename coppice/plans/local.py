"""Finishing a node in memory: level-wise training on numpy columns, to any depth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from coppice.functions.impurity import impurity_of, predict_of
from coppice.operators.metadata import Metadata
from coppice.operators.search import Found, Split, best_split
from coppice.plans.tree import Tree

#: (bins rows x features, labels, weights, metadata, thresholds, depth limit, seed) -> subtree; a user's own may be passed.
LocalTrainer = Callable[..., Tree]


def moments(labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, wy, wyy) of rows; labels of merged rows are (wy, wyy) already."""
    if labels.ndim == 2:
        return weights, labels[:, 0], labels[:, 1]
    return weights, weights * labels, weights * labels * labels


def statistics(labels: np.ndarray, weights: np.ndarray, meta: Metadata) -> np.ndarray:
    """Row-wise statistics whose sums are a node's."""
    if meta.classify:
        out = np.zeros((len(labels), meta.num_classes))
        out[np.arange(len(labels)), labels.astype(np.int64)] = weights
        return out
    return np.stack(moments(labels, weights), 1)


def cells(column: np.ndarray, size: int, labels: np.ndarray, weights: np.ndarray, meta: Metadata) -> np.ndarray:
    """Histogram (bins x statistics) of one feature."""
    if meta.classify:
        k = meta.num_classes
        return np.bincount(column * k + labels.astype(np.int64), weights, minlength=size * k).reshape(size, k)
    return np.stack([np.bincount(column, w, minlength=size) for w in moments(labels, weights)], 1)


def node_features(meta: Metadata, seed: int, tree: int, node: Sequence[int] | int) -> list[int]:
    """The features a node may split on, drawn anew for each node from (seed, tree, node)."""
    if meta.features_per_node >= meta.num_features:
        return list(range(meta.num_features))
    key = [seed & (1 << 63) - 1, tree, *(node if isinstance(node, Sequence) else [node])]
    return np.random.default_rng(key).permutation(meta.num_features)[: meta.features_per_node].tolist()


def apply_split(tree: Tree, node: int, found: Found, meta: Metadata, thresholds: Sequence[Sequence[float]]) -> tuple[int, int]:
    """Makes an inner node of a leaf; returns its children."""
    split: Split = found.split
    tree.feature[node], tree.gain[node] = split.feature, found.gain
    if split.left is None:
        tree.threshold[node], tree.bin[node] = thresholds[split.feature][split.bin], split.bin
    else:
        tree.categories[node], tree.arity[node] = split.left, meta.arity[split.feature]
    for side, stats in (("left", found.left), ("right", found.right)):
        getattr(tree, side)[node] = tree.add(float(predict_of(stats, meta.impurity)), float(impurity_of(stats, meta.impurity)))
    return tree.left[node], tree.right[node]


def usable(found: Found, meta: Metadata, here: bool = False) -> bool:
    """The leaf rule: a split must gain, or with ``zero_gain`` only be valid; ``zero_gain_locally`` says so for nodes finished ``here``."""
    return found.valid and (found.gain > 0 or meta.zero_gain or (here and meta.zero_gain_locally))


def goes_left(column: np.ndarray, split: Split, arity: int) -> np.ndarray:
    if split.left is None:
        return column <= split.bin
    table = np.zeros(max(arity, 1), bool)
    table[list(split.left)] = True
    return table[column]


def fit(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, meta: Metadata, thresholds: Sequence[Sequence[float]], depth: int, seed: int = 0, tree_key: Sequence[int] = (0,)) -> Tree:
    """A subtree of at most ``depth`` levels below its root. Rows of a node stay in one contiguous, stably parted range."""
    columns = np.ascontiguousarray(bins.T)
    stats = statistics(labels, weights, meta).sum(0)
    tree = Tree()
    tree.add(float(predict_of(stats, meta.impurity)), float(impurity_of(stats, meta.impurity)))
    level: list[tuple[int, np.ndarray]] = [(0, np.arange(len(labels)))]
    for _ in range(depth):
        after: list[tuple[int, np.ndarray]] = []
        for node, rows in level:
            chosen = node_features(meta, seed, tree_key[0], [*tree_key[1:], node])
            own_labels, own_weights = labels[rows], weights[rows]
            histograms = [cells(columns[f, rows], meta.bins(f), own_labels, own_weights, meta) for f in chosen]
            found = best_split(histograms, chosen, meta)
            if not usable(found, meta, here=True):
                if node == 0 and not found.valid:
                    tree.impurity[0] = -1.0
                continue
            kids = apply_split(tree, node, found, meta, thresholds)
            left = goes_left(columns[found.split.feature, rows], found.split, meta.arity[found.split.feature])
            after += [(k, r) for k, r in zip(kids, (rows[left], rows[~left])) if tree.impurity[k] != 0]
        if not after:
            break
        level = after
    return tree
