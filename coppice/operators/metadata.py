"""What training has to know about its input before the first pass over the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from coppice.functions.impurity import checked, stats_size


@dataclass(frozen=True)
class Metadata:
    """Feature kinds, bins and limits. ``arity`` is 0 for a continuous feature."""

    num_features: int
    num_rows: int
    num_classes: int
    max_bins: int
    arity: tuple[int, ...]
    unordered: frozenset[int]
    impurity: str
    min_instances: float = 1
    min_gain: float = 0.0
    max_depth: int = 5
    num_trees: int = 1
    features_per_node: int = 0
    zero_gain: bool = False
    zero_gain_locally: bool = False
    num_splits: tuple[int, ...] = field(default=())

    @property
    def classify(self) -> bool:
        return self.impurity != "variance"

    @property
    def stats(self) -> int:
        return stats_size(self.impurity, self.num_classes)

    def bins(self, feature: int) -> int:
        """Histogram cells of a feature: its categories, or one more than its thresholds."""
        return self.arity[feature] if self.arity[feature] > 1 else self.num_splits[feature] + 1

    def is_continuous(self, feature: int) -> bool:
        return self.arity[feature] <= 1


def unordered_bins(arity: int) -> int:
    """Ways to part ``arity`` categories in two."""
    return (1 << (arity - 1)) - 1


def most_unordered(max_bins: int) -> int:
    """Largest arity whose parts are all tried, if there are more than two classes."""
    return math.floor(math.log2(max_bins // 2 + 1) + 1)


def features_per_node(strategy: str, num_features: int, num_trees: int, classify: bool) -> int:
    """auto, all, sqrt, log2, onethird, a whole number (at most all), or a share in (0, 1]."""
    s = str(strategy).lower()
    if s == "auto":
        s = "all" if num_trees == 1 else "sqrt" if classify else "onethird"
    named = {"all": num_features, "sqrt": math.ceil(math.sqrt(num_features)), "log2": max(1, math.ceil(math.log2(num_features))), "onethird": math.ceil(num_features / 3)}
    if s in named:
        return named[s]
    try:
        if s.isdigit() and int(s) > 0:
            return min(int(s), num_features)
        if "." in s or "e" in s:
            share = float(s)
            if 0 < share <= 1:
                return max(1, math.ceil(share * num_features))
    except ValueError:
        pass
    raise ValueError(f"unknown feature subset strategy {strategy!r}")


def build(
    num_features: int,
    num_rows: int,
    num_classes: int,
    categorical: dict[int, int] | None,
    impurity: str,
    classify: bool,
    max_bins: int = 32,
    strategy: str = "auto",
    num_trees: int = 1,
    **limits,
) -> Metadata:
    """Caps ``max_bins`` at the rows, checks arities against it and decides which categorical features are unordered."""
    if num_rows < 1 or num_features < 1:
        raise ValueError("training needs rows and features")
    impurity = checked(impurity, classify)
    bins = min(max_bins, num_rows)
    arity = [0] * num_features
    for f, k in (categorical or {}).items():
        if not 0 <= f < num_features or k < 1:
            raise ValueError(f"categorical feature {f} with {k} categories")
        if k > bins:
            raise ValueError(f"feature {f} has {k} categories, more than {bins} bins (maxBins {max_bins}, {num_rows} rows)")
        arity[f] = k
    many = classify and num_classes > 2
    unordered = frozenset(f for f, k in enumerate(arity) if many and 1 < k <= most_unordered(bins))
    per_node = features_per_node(strategy, num_features, num_trees, classify)
    return Metadata(num_features, num_rows, num_classes if classify else 0, bins, tuple(arity), unordered, impurity, num_trees=num_trees, features_per_node=per_node, **limits)
