"""Training frames: rows of label, features and weight, with feature kinds from column metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def features_array(df: DataFrame, name: str) -> Column:
    """A vector or array column as array<double>."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.col(f"`{name}`").cast("array<double>")
    return vector_to_array(F.col(f"`{name}`"))


def feature_kinds(df: DataFrame, name: str) -> dict[int, int]:
    """Feature -> number of categories, from the attributes that ML transformers leave in the column's metadata."""
    attrs = (df.schema[name].metadata or {}).get("ml_attr", {}).get("attrs", {})
    out = {}
    for a in (*attrs.get("nominal", []), *attrs.get("binary", [])):
        size = len(a["vals"]) if "vals" in a else a.get("num_vals", 2 if a in attrs.get("binary", []) else None)
        if size is None:
            raise ValueError(f"nominal feature {a.get('idx')} without its number of values")
        out[int(a["idx"])] = int(size)
    return out


def num_classes(df: DataFrame, label: str) -> int:
    """From the label's metadata, else one more than its largest value."""
    attr = (df.schema[label].metadata or {}).get("ml_attr", {})
    if "vals" in attr:
        return len(attr["vals"])
    if "num_vals" in attr:
        return int(attr["num_vals"])
    top = df.agg(F.max(F.col(f"`{label}`").cast("double")).alias("m")).first()["m"]
    if top is None or top < 0 or top != int(top):
        raise ValueError(f"labels must be whole numbers from 0 on; the largest is {top}")
    return int(top) + 1


def training_frame(df: DataFrame, label: str, features: str, weight: str | None = None, row_id: str | None = None) -> DataFrame:
    """label, weight, features and row_id of ``df``; nothing else is read. Without a weight column rows weigh 1.

    Without ``row_id``, rows are keyed by a digest of their content, so equal rows share their draws.
    """
    own = features_array(df, features)
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    y = F.col(f"`{label}`").cast("double")
    key = F.xxhash64(own, y) if row_id is None else F.xxhash64(F.col(f"`{row_id}`"))
    return df.select(y.alias("label"), w.alias("weight"), own.alias("features"), key.alias("row_id"))


def num_features(frame: DataFrame) -> int:
    first = frame.select(F.size("features").alias("n")).first()
    if first is None:
        raise ValueError("no rows to train on")
    return int(first["n"])


def labeled_points(spark, points: Iterable[tuple[float, Iterable[float]]], weights: Iterable[float] | None = None) -> DataFrame:
    """A frame from (label, features) pairs and weights in the same order."""
    points = list(points)
    weights = [1.0] * len(points) if weights is None else list(weights)
    if len(weights) != len(points):
        raise ValueError(f"{len(weights)} weights for {len(points)} points")
    rows = [(i, float(y), [float(v) for v in x], float(w)) for i, ((y, x), w) in enumerate(zip(points, weights))]
    return spark.createDataFrame(rows, "row_id long, label double, features array<double>, weight double")
