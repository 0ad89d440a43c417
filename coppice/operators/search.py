"""The best split of a node from its histogram, as array operations, and of one level as windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.impurity import COLUMNS, INVALID_GAIN, centroids, impurity_of, weight
from coppice.operators.metadata import Metadata
from coppice.operators.splits import unordered_subsets


@dataclass
class Split:
    """A continuous split sends bins up to ``bin`` left, a categorical one the categories in ``left``."""

    feature: int
    bin: int = -1
    left: tuple[int, ...] | None = None


@dataclass
class Found:
    split: Split | None
    gain: float
    stats: np.ndarray
    left: np.ndarray | None = None
    right: np.ndarray | None = None

    @property
    def valid(self) -> bool:
        return self.split is not None and self.gain > INVALID_GAIN


def gains(parent: np.ndarray, left: np.ndarray, right: np.ndarray, meta: Metadata) -> np.ndarray:
    """Gain of each split; INVALID_GAIN where a side is too light or the gain too small."""
    nl, nr = weight(left, meta.impurity), weight(right, meta.impurity)
    n = weight(parent, meta.impurity)
    total = np.where(n == 0, 1.0, n)
    gain = impurity_of(parent, meta.impurity) - nl / total * impurity_of(left, meta.impurity) - nr / total * impurity_of(right, meta.impurity)
    return np.where((nl < meta.min_instances) | (nr < meta.min_instances) | (gain < meta.min_gain), INVALID_GAIN, gain)


def feature_split(cells: np.ndarray, feature: int, meta: Metadata) -> Found | None:
    """Best split of one feature from its cells (bins x statistics); None for a constant feature."""
    parent = cells.sum(0)
    if meta.is_continuous(feature):
        if meta.num_splits[feature] == 0:
            return None
        left = np.cumsum(cells[: meta.num_splits[feature] + 1], 0)[:-1]
        options: Sequence = range(len(left))
    elif feature in meta.unordered:
        options = unordered_subsets(meta.arity[feature])
        left = np.stack([cells[o].sum(0) for o in options])
    else:
        own = cells[: meta.arity[feature]]
        order = np.argsort(centroids(own, meta.impurity), kind="stable")
        left = np.cumsum(own[order], 0)[:-1]
        options = [tuple(order[: i + 1].tolist()) for i in range(len(left))]
    right = parent - left
    gain = gains(parent, left, right, meta)
    best = int(gain.argmax())
    split = Split(feature, best) if meta.is_continuous(feature) else Split(feature, left=tuple(sorted(options[best])))
    return Found(split, float(gain[best]), parent, left[best], right[best])


def best_split(cells: np.ndarray, features: Sequence[int], meta: Metadata) -> Found:
    """The first feature of the highest gain; without a usable split, one of INVALID_GAIN."""
    best: Found | None = None
    for i, f in enumerate(features):
        found = feature_split(cells[i], f, meta)
        if found is not None and (best is None or found.gain > best.gain):
            best = found
    if best is None or not best.valid:
        return Found(None, INVALID_GAIN, cells[0].sum(0))
    return best


def histogram(df: DataFrame, bins: list[tuple[str, Column]], stats: dict[str, Column]) -> DataFrame:
    """(feature, bin, statistics) of one node as an aggregation: rows are spread over features, then summed."""
    cells = F.array(*(F.struct(F.lit(i).alias("feature"), b.cast("int").alias("bin")) for i, (_, b) in enumerate(bins)))
    own = df.select(F.explode(cells).alias("c"), *(s.alias(n) for n, s in stats.items()))
    return own.groupBy("c.feature", "c.bin").agg(*(F.sum(n).alias(n) for n in stats))


def split_gains(cells: DataFrame, impurity: str, stats: Sequence[str], group: Sequence[str] = (), order: str = "bin", least: float = 1, min_gain: float = 0.0) -> DataFrame:
    """Gain of every ordered split of every feature: running sums along ``order`` against the totals."""
    whole = Window.partitionBy(*group, "feature")
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = cells.select("*", *(F.sum(s).over(upto).alias(f"l_{s}") for s in stats), *(F.sum(s).over(whole).alias(f"t_{s}") for s in stats))
    named = named.select("*", *((F.col(f"t_{s}") - F.col(f"l_{s}")).alias(f"r_{s}") for s in stats))
    side = lambda k: [F.col(f"{k}_{s}") for s in stats]
    size = lambda k: F.col(f"{k}_{stats[0]}") if impurity == "variance" else sum(side(k)[1:], side(k)[0])
    of = COLUMNS[impurity]
    named = named.where((size("l") >= least) & (size("r") >= least) & (size("r") > 0))
    gain = of(*side("t")) - size("l") / size("t") * of(*side("l")) - size("r") / size("t") * of(*side("r"))
    return named.withColumn("gain", gain).where(F.col("gain") >= min_gain)


def best_of(gains: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row a node: the highest gain, then the first feature and bin."""
    if not group:
        return gains.orderBy(F.desc("gain"), "feature", "bin").limit(1)
    first = Window.partitionBy(*group).orderBy(F.desc("gain"), "feature", "bin")
    return gains.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
