"""Impurity measures. Statistics of a node are class weights, or (w, wy, wyy) for variance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSIFY, REGRESS = ("gini", "entropy"), ("variance",)
INVALID_GAIN = -np.finfo(np.float64).max
FARTHEST = np.finfo(np.float64).max


def checked(impurity: str, classify: bool) -> str:
    name = impurity.lower()
    if name not in (CLASSIFY if classify else REGRESS):
        raise ValueError(f"impurity {impurity!r} isn't one of {CLASSIFY if classify else REGRESS}")
    return name


def stats_size(impurity: str, num_classes: int) -> int:
    return 3 if impurity == "variance" else num_classes


def weight(stats: np.ndarray, impurity: str) -> np.ndarray:
    """Weighted rows; the last axis holds the statistics."""
    return stats[..., 0] if impurity == "variance" else stats.sum(-1)


def impurity_of(stats: np.ndarray, impurity: str) -> np.ndarray:
    """0 for an empty node."""
    n = weight(stats, impurity)
    safe = np.where(n == 0, 1.0, n)
    if impurity == "variance":
        return np.where(n == 0, 0.0, (stats[..., 2] - stats[..., 1] * stats[..., 1] / safe) / safe)
    p = stats / safe[..., None]
    if impurity == "gini":
        return np.where(n == 0, 0.0, 1.0 - (p * p).sum(-1))
    terms = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0)
    return np.where(n == 0, 0.0, -terms.sum(-1))


def predict_of(stats: np.ndarray, impurity: str) -> np.ndarray:
    """The class of most weight (the first of several), or the mean."""
    if impurity == "variance":
        return np.where(stats[..., 0] == 0, 0.0, stats[..., 1] / np.where(stats[..., 0] == 0, 1.0, stats[..., 0]))
    return stats.argmax(-1).astype(np.float64)


def centroids(stats: np.ndarray, impurity: str) -> np.ndarray:
    """Sort key of the categories of an ordered feature: many classes by impurity, two by the weight of class 1, else by
    mean; categories without rows come last."""
    n = weight(stats, impurity)
    if impurity == "variance":
        key = predict_of(stats, impurity)
    elif stats.shape[-1] > 2:
        key = impurity_of(stats, impurity)
    else:
        key = stats[..., -1]
    return np.where(n == 0, FARTHEST, key)


def gini(*weights: Column) -> Column:
    total = sum(weights[1:], weights[0])
    return F.lit(1.0) - sum(((w / total) * (w / total) for w in weights[1:]), (weights[0] / total) * (weights[0] / total))


def entropy(*weights: Column) -> Column:
    total = sum(weights[1:], weights[0])
    term = lambda w: F.when(w > 0, -(w / total) * F.log2(w / total)).otherwise(0.0)
    return sum((term(w) for w in weights[1:]), term(weights[0]))


def variance(w: Column, wy: Column, wyy: Column) -> Column:
    return (wyy - wy * wy / w) / w


COLUMNS = {"gini": gini, "entropy": entropy, "variance": variance}
