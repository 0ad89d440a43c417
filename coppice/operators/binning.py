"""Rows as bin numbers: thresholds bound bins on the right, so a value equal to one lies left of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.metadata import Metadata


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of thresholds below the value; NaN goes to the last bin."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit([float(c) for c in cuts]), lambda t: t < value))


def category_of(value: Column, arity: int, feature: int) -> Column:
    c = value.cast("int")
    wrong = F.concat(F.lit(f"feature {feature} has {arity} categories, but a row has "), value.cast("string"))
    return F.when((c >= 0) & (c < arity) & (c == value), c).otherwise(F.raise_error(wrong).cast("int"))


def bin_rows(df: DataFrame, meta: Metadata, cuts: list[list[float]]) -> DataFrame:
    """Adds ``bins`` (array<int>) to rows with ``features`` (array<double>)."""
    cell = lambda f: F.get("features", F.lit(f))
    own = [bin_of(cell(f), cuts[f]) if meta.is_continuous(f) else category_of(cell(f), meta.arity[f], f) for f in range(meta.num_features)]
    return df.withColumn("bins", F.array(*own))


def cells_of(meta: Metadata) -> int:
    """Most rows that ``merge_rows`` gives: combinations of bins, times the classes."""
    return math.prod(meta.bins(f) for f in range(meta.num_features)) * max(1, meta.num_classes)


def merge_rows(rows: DataFrame, meta: Metadata, num_trees: int) -> DataFrame:
    """Rows of the same bins (and class) as one: they share every node of a tree, so a tree needs no more than their sums.

    ``bag`` then holds the weight of each tree, ``weight`` is 1, and for regression ``label`` holds (wy, wyy) of each tree.
    """
    sizes = [meta.bins(f) for f in range(meta.num_features)]
    strides = [math.prod(sizes[:f]) for f in range(meta.num_features)]
    cell = sum((F.get("bins", F.lit(f)).cast("long") * F.lit(s).cast("long") for f, s in enumerate(strides)), F.lit(0).cast("long"))
    known = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))  # noqa: E731  # sums pass over nulls
    y, drawn = known("label"), [F.get("bag", F.lit(t)) for t in range(num_trees)]
    total = lambda t, v: F.sum(F.when(drawn[t] > 0, drawn[t] * v).otherwise(0.0))
    sums = [total(t, known("weight")).alias(f"w{t}") for t in range(num_trees)]
    if not meta.classify:
        sums += [total(t, known("weight") * v).alias(f"{n}{t}") for t in range(num_trees) for n, v in (("wy", y), ("wyy", y * y))]
    keys = [cell.alias("cell"), *([F.col("label")] if meta.classify else [])]
    label = F.col("label") if meta.classify else F.array(*(f"{n}{t}" for t in range(num_trees) for n in ("wy", "wyy")))
    bins = F.array(*(F.expr(f"CAST(cell div {s} % {n} AS INT)") for s, n in zip(strides, sizes)))
    return rows.groupBy(*keys).agg(*sums).select(bins.alias("bins"), label.alias("label"), F.lit(1.0).alias("weight"), F.array(*(f"w{t}" for t in range(num_trees))).alias("bag"))
