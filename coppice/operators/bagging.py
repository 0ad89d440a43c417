"""Bags: how often each tree sees each row, from a digest of the row and the tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(row: Column, tree: int, seed: int) -> Column:
    """A number in [0, 1) that depends on row key, tree and seed only, so a lost task gives the same bag again."""
    return F.shiftrightunsigned(F.xxhash64(row, F.lit(tree), F.lit(seed)), 11) * F.lit(2.0**-53)


def poisson(u: Column, rate: float) -> Column:
    """Inverse of the Poisson distribution at ``u``."""
    p = total = math.exp(-rate)
    out, k = F.lit(0.0), 0
    steps = []
    while total < 1 - 1e-12 and k < 100:
        steps.append((total, k + 1))
        k += 1
        p *= rate / k
        total += p
    for bound, count in steps:
        out = F.when(u >= bound, float(count)).otherwise(out)
    return out


def bag(df: DataFrame, num_trees: int, rate: float, seed: int, row: str = "row_id") -> DataFrame:
    """Adds ``bag`` (array<double>, one weight a tree): several trees draw with replacement, one tree without."""
    if num_trees > 1:
        weights = [poisson(uniform(F.col(row), t, seed), rate) for t in range(num_trees)]
    elif rate < 1:
        weights = [F.when(uniform(F.col(row), 0, seed) < rate, 1.0).otherwise(0.0)]
    else:
        weights = [F.lit(1.0)]
    return df.withColumn("bag", F.array(*weights))
