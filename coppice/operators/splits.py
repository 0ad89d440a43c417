"""Candidate splits: thresholds between sorted distinct values, and subsets of categories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.metadata import Metadata, unordered_bins

LEAST_SAMPLE = 10_000


def distinct_counts(df: DataFrame, features: str = "features") -> DataFrame:
    """(feature, value, n) of every value of every feature of an array column; partial sums before the shuffle."""
    return df.select(F.posexplode(features).alias("feature", "value")).groupBy("feature", "value").agg(F.count("*").alias("n"))


class Thresholds:
    """Thresholds of one feature from its distinct values in ascending order, which may come in parts.

    At most ``most`` midpoints of neighbouring values: all, if there are no more of them, or those where the running count
    has come nearest to the next multiple of the stride; no more than one a value.
    """

    def __init__(self, distinct: int, total: float, most: int) -> None:
        self.every = distinct - 1 <= most
        self.stride = self.target = total / (most + 1)
        self.last: float | None = None
        self.running = 0
        self.found: list[float] = []

    def add(self, values: Sequence[float], counts: Sequence[int]) -> None:
        for value, n in zip(values, counts):
            before, self.running = self.running, self.running + n
            if self.last is not None:
                if self.every:
                    self.found.append((self.last + value) / 2)
                elif abs(before - self.target) < abs(self.running - self.target):
                    self.found.append((self.last + value) / 2)
                    self.target += self.stride
            self.last = value


def thresholds(values: Sequence[float], counts: Sequence[int], most: int) -> list[float]:
    """The thresholds of one feature at once."""
    out = Thresholds(len(values), sum(counts), most)
    out.add(values, counts)
    return out.found


def sample_share(num_rows: int, max_bins: int) -> float:
    """Share of rows from which thresholds are taken."""
    needed = max(max_bins * max_bins, LEAST_SAMPLE)
    return 1.0 if num_rows <= needed else needed / num_rows


def find_thresholds(df: DataFrame, meta: Metadata, seed: int, custom: Sequence[Sequence[float]] | None = None, exact: bool = False) -> list[list[float]]:
    """Thresholds of each continuous feature ([] for categorical ones), from a sample as large as needed or all rows.

    Only thresholds come to the driver: each feature's distinct values are folded on an executor.
    """
    if custom is not None:
        if len(custom) != meta.num_features:
            raise ValueError(f"custom splits for {len(custom)} features, but there are {meta.num_features}")
        return [sorted(map(float, c)) if meta.is_continuous(f) else [] for f, c in enumerate(custom)]
    share = 1.0 if exact else sample_share(meta.num_rows, meta.max_bins)
    rows = df.select("features") if share >= 1 else df.select("features").sample(False, share, seed)
    continuous = [f for f in range(meta.num_features) if meta.is_continuous(f)]
    out: list[list[float]] = [[] for _ in range(meta.num_features)]
    if not continuous:
        return out
    counted = distinct_counts(rows)
    if len(continuous) < meta.num_features:
        counted = counted.where(F.col("feature").isin(continuous))
    most = meta.max_bins - 1

    counted = counted.persist()
    try:
        sizes = {r["feature"]: (r["distinct"], r["total"]) for r in counted.groupBy("feature").agg(F.count("*").alias("distinct"), F.sum("n").alias("total")).collect()}

        def fold(batches):
            """Sorted values of whole features, as they stream by: no task holds more than a batch and the thresholds."""
            own: dict[int, Thresholds] = {}
            for batch in batches:
                feature, value, n = (batch.column(i).to_numpy() for i in range(3))
                cuts = np.append(np.flatnonzero(np.diff(feature, prepend=-1)), len(feature))
                for a, z in zip(cuts, cuts[1:]):
                    f = int(feature[a])
                    own.setdefault(f, Thresholds(*sizes[f], most)).add(value[a:z].tolist(), n[a:z].tolist())
            lists = [own[f].found for f in own]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], names=["feature", "cut"])

        ordered = counted.select(F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("value"), "n").repartition("feature").sortWithinPartitions("feature", "value")
        for r in ordered.mapInArrow(fold, "feature int, cut array<double>").collect():
            out[r["feature"]] = list(r["cut"])
    finally:
        counted.unpersist()
    return out


def subset(number: int, arity: int) -> list[int]:
    """The categories whose bits are set in ``number``, highest first."""
    return [c for c in range(arity - 1, -1, -1) if number >> c & 1]


def unordered_subsets(arity: int) -> list[list[int]]:
    """Left sides of all ways to part the categories in two, in order of their number."""
    return [subset(i + 1, arity) for i in range(unordered_bins(arity))]
