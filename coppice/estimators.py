"""Estimators and models for decision trees and random forests, and functions that train from frames of points."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.impurity import CLASSIFY, REGRESS
from coppice.plans.grow import Result, Strategy, train
from coppice.plans.local import LocalTrainer
from coppice.plans.local import fit as fit_locally
from coppice.plans.schedule import TimePrediction, by_rows
from coppice.plans.tree import Tree
from coppice.sources import frames, models


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class _Columns(Params):
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    featuresCol = _param("featuresCol", "features column: vector or array of numbers", TypeConverters.toString)
    weightCol = _param("weightCol", "weight column; rows weigh 1 if the frame has none of this name", TypeConverters.toString)
    rowIdCol = _param("rowIdCol", "key column that draws depend on; content if unset", TypeConverters.toString)
    predictionCol = _param("predictionCol", "prediction column", TypeConverters.toString)
    rawPredictionCol = _param("rawPredictionCol", "votes of each class", TypeConverters.toString)
    probabilityCol = _param("probabilityCol", "share of votes of each class", TypeConverters.toString)
    thresholds = _param("thresholds", "a class wins by its share over its threshold", TypeConverters.toListFloat)


class _Settings(_Columns):
    impurity = _param("impurity", "impurity measure", TypeConverters.toString)
    maxDepth = _param("maxDepth", "levels below the root", TypeConverters.toInt)
    maxBins = _param("maxBins", "bins of a continuous feature, categories at most", TypeConverters.toInt)
    minInstancesPerNode = _param("minInstancesPerNode", "least weight of a child", TypeConverters.toFloat)
    minInfoGain = _param("minInfoGain", "least gain of a split", TypeConverters.toFloat)
    maxMemoryInMB = _param("maxMemoryInMB", "memory of the histograms of one pass", TypeConverters.toInt)
    cacheNodeIds = _param("cacheNodeIds", "keep each row's nodes instead of walking the trees", TypeConverters.toBoolean)
    checkpointInterval = _param("checkpointInterval", "levels between checkpoints of kept nodes; -1: none", TypeConverters.toInt)
    maxMemoryMultiplier = _param("maxMemoryMultiplier", "memory of a local task over that of its rows", TypeConverters.toFloat)
    maxTasksPerBin = _param("maxTasksPerBin", "most local tasks in one bin", TypeConverters.toInt)
    localMaxRows = _param("localMaxRows", "rows below which a node is finished locally, as far as memory holds them; derived from memory if unset", TypeConverters.toInt)
    exactSplits = _param("exactSplits", "find thresholds from all rows", TypeConverters.toBoolean)
    zeroGainLocally = _param("zeroGainLocally", "accept them in nodes finished locally, though not above", TypeConverters.toBoolean)
    zeroGain = _param("zeroGain", "accept valid splits that gain nothing", TypeConverters.toBoolean)
    seed = _param("seed", "seed", TypeConverters.toInt)
    numTrees = _param("numTrees", "trees of a forest", TypeConverters.toInt)
    subsamplingRate = _param("subsamplingRate", "share of rows a tree sees", TypeConverters.toFloat)
    featureSubsetStrategy = _param("featureSubsetStrategy", "features a node may split on", TypeConverters.toString)

    def _defaults(self, classify: bool, forest: bool) -> None:
        self._setDefault(
            labelCol="label", featuresCol="features", weightCol="weight", predictionCol="prediction", impurity="gini" if classify else "variance", maxDepth=5, maxBins=32,
            minInstancesPerNode=1.0, minInfoGain=0.0, maxMemoryInMB=256, cacheNodeIds=True, checkpointInterval=10, maxMemoryMultiplier=4.0, maxTasksPerBin=(1 << 31) - 1,
            exactSplits=False, zeroGain=False, zeroGainLocally=False, seed=17,
        )
        if classify:
            self._setDefault(rawPredictionCol="rawPrediction", probabilityCol="probability")
        if forest:
            self._setDefault(numTrees=20, subsamplingRate=1.0, featureSubsetStrategy="auto")


def _accessors(cls):
    """setX and getX of each parameter."""
    for name in [n for n in dir(cls) if isinstance(getattr(cls, n), Param)]:
        setattr(cls, "set" + name[0].upper() + name[1:], lambda self, value, _n=name: self._set(**{_n: value}))
        setattr(cls, "get" + name[0].upper() + name[1:], lambda self, _n=name: self.getOrDefault(_n))
    return cls


@_accessors
class _TreeEstimator(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Custom splits, local trainer and time prediction are plain attributes: ``copy`` carries them; an estimator that has any
    refuses to be saved, as they would be lost."""

    _classify = True
    _forest = False

    def __init__(self, **params: Any) -> None:
        super().__init__()
        self._defaults(self._classify, self._forest)
        self.customSplits: Sequence[Sequence[float]] | None = None
        self.localTrainingAlgorithm: LocalTrainer = fit_locally
        self.timePredictionStrategy: TimePrediction = by_rows
        if not self._forest and {"numTrees", "subsamplingRate", "featureSubsetStrategy"} & params.keys():
            raise ValueError("a single tree sees all rows and features")
        self._set(**params)

    def write(self):
        own = {"customSplits": self.customSplits is not None, "localTrainingAlgorithm": self.localTrainingAlgorithm is not fit_locally, "timePredictionStrategy": self.timePredictionStrategy is not by_rows}
        if any(own.values()):
            raise ValueError("can't be saved: " + ", ".join(k for k, v in own.items() if v))
        return super().write()

    def setCustomSplits(self, value):
        self.customSplits = value
        return self

    def setLocalTrainingAlgorithm(self, value: LocalTrainer):
        self.localTrainingAlgorithm = value
        return self

    def setTimePredictionStrategy(self, value: TimePrediction):
        self.timePredictionStrategy = value
        return self

    def strategy(self, df: DataFrame) -> Strategy:
        """The settings for this frame."""
        get = self.getOrDefault
        label, features = get("labelCol"), get("featuresCol")
        return Strategy(
            classify=self._classify,
            impurity=get("impurity"),
            max_depth=get("maxDepth"),
            num_classes=max(2, frames.num_classes(df, label)) if self._classify else 0,
            max_bins=get("maxBins"),
            categorical=frames.feature_kinds(df, features),
            min_instances=get("minInstancesPerNode"),
            min_gain=get("minInfoGain"),
            num_trees=get("numTrees") if self._forest else 1,
            features=get("featureSubsetStrategy") if self._forest else "all",
            subsampling=get("subsamplingRate") if self._forest else 1.0,
            seed=get("seed"),
            max_memory_mb=get("maxMemoryInMB"),
            cache_node_ids=get("cacheNodeIds"),
            checkpoint_interval=get("checkpointInterval"),
            max_memory_multiplier=get("maxMemoryMultiplier"),
            max_tasks_per_bin=get("maxTasksPerBin"),
            custom_splits=self.customSplits,
            local_trainer=self.localTrainingAlgorithm,
            time_prediction=self.timePredictionStrategy,
            local_max_rows=get("localMaxRows") if self.isDefined("localMaxRows") else None,
            exact_splits=get("exactSplits"),
            zero_gain=get("zeroGain"),
            zero_gain_locally=get("zeroGainLocally"),
        )

    def _frame(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        weight = get("weightCol") if get("weightCol") in df.columns else None
        if weight is None and self.isSet("weightCol"):
            raise ValueError(f"no weight column {get('weightCol')!r}")
        return frames.training_frame(df, get("labelCol"), get("featuresCol"), weight, get("rowIdCol") if self.isDefined("rowIdCol") else None)

    def fit_with_statistics(self, df: DataFrame) -> tuple[ForestModel, DataFrame]:
        """(model, one row per locally finished node: tree, node, rows, impurity, seconds)."""
        frame = self._frame(df)
        strategy = self.strategy(df)
        result = train(frame, strategy, frames.num_features(frame))
        model = self._model(result, strategy)
        stats = df.sparkSession.createDataFrame(result.nodes, "tree int, node int, rows double, impurity double, seconds double")
        return model, stats

    def _model(self, result: Result, strategy: Strategy) -> ForestModel:
        kind = ClassificationModel if self._classify else RegressionModel
        model = kind(result.trees, result.meta.num_features, strategy.num_classes)
        model.seconds = result.seconds
        names = [p.name for p in _Columns().params if self.isDefined(p.name)]
        model._set(**{n: self.getOrDefault(n) for n in names if model.hasParam(n)})
        return model

    def _fit(self, df: DataFrame) -> ForestModel:
        frame, strategy = self._frame(df), self.strategy(df)
        return self._model(train(frame, strategy, frames.num_features(frame)), strategy)


class DecisionTreeClassifier(_TreeEstimator):
    """One tree for whole-number labels."""


class DecisionTreeRegressor(_TreeEstimator):
    """One tree for numeric labels."""

    _classify = False


class RandomForestClassifier(_TreeEstimator):
    """A forest that votes: each tree has one vote for its class."""

    _forest = True


class RandomForestRegressor(_TreeEstimator):
    """A forest whose prediction is the mean of its trees."""

    _classify, _forest = False, True


@_accessors
class ForestModel(Model, _Columns):
    """Trees and what is known of them. Weights of all trees are 1."""

    def __init__(self, trees: list[Tree], num_features: int, num_classes: int) -> None:
        super().__init__()
        self.trees, self.num_features, self.num_classes = trees, num_features, num_classes
        self.seconds: dict[str, float] = {}
        self._setDefault(labelCol="label", featuresCol="features", predictionCol="prediction")

    @property
    def tree_weights(self) -> list[float]:
        return [1.0] * len(self.trees)

    @property
    def num_nodes(self) -> int:
        return sum(map(len, self.trees))

    @property
    def depth(self) -> int:
        return max(t.depth() for t in self.trees)

    def max_feature(self) -> int:
        return max(t.max_feature() for t in self.trees)

    def debug_string(self) -> str:
        return "\n".join(f"Tree {i} (weight 1.0, depth {t.depth()}, {len(t)} nodes):\n{t.describe()}" for i, t in enumerate(self.trees))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return models.node_table(spark, self.trees)

    def _matrix(self, rows: Sequence[Sequence[float]]) -> np.ndarray:
        return np.array(rows, np.float64).reshape(len(rows), -1)

    def save(self, path: str, overwrite: bool = False, spark: SparkSession | None = None) -> None:
        settings = {"kind": type(self).__name__, "num_features": self.num_features, "num_classes": self.num_classes}
        settings["params"] = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        models.save(spark or SparkSession.active(), path, self.trees, settings, overwrite)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> ForestModel:
        trees, settings = models.load(spark or SparkSession.active(), path)
        kind = {c.__name__: c for c in (ClassificationModel, RegressionModel)}[settings["kind"]]
        model = kind(trees, settings["num_features"], settings["num_classes"])
        return model._set(**settings["params"])

    def same(self, other: ForestModel) -> bool:
        return len(self.trees) == len(other.trees) and all(a.same(b) for a, b in zip(self.trees, other.trees))


class ClassificationModel(ForestModel):
    def __init__(self, trees: list[Tree], num_features: int, num_classes: int) -> None:
        super().__init__(trees, num_features, num_classes)
        self._setDefault(rawPredictionCol="rawPrediction", probabilityCol="probability")

    def votes(self, rows: Sequence[Sequence[float]]) -> np.ndarray:
        x = self._matrix(rows)
        out = np.zeros((len(x), self.num_classes))
        for t in self.trees:
            out[np.arange(len(x)), t.flat().predict(x).astype(np.int64)] += 1
        return out

    def predict(self, row: Sequence[float]) -> float:
        return float(self.votes([list(row)])[0].argmax())

    def _transform(self, df: DataFrame) -> DataFrame:
        flats, classes = [t.flat() for t in self.trees], self.num_classes

        @F.pandas_udf("array<double>")
        def vote(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            out = np.zeros((len(x), classes))
            for f in flats:
                out[np.arange(len(x)), f.predict(x).astype(np.int64)] += 1
            return pd.Series(list(out))

        get = self.getOrDefault
        voted = df.withColumn("_votes", vote(frames.features_array(df, get("featuresCol"))))
        total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
        share = F.transform("_votes", lambda v: F.when(total > 0, v / total).otherwise(v))
        score = share
        if self.isDefined("thresholds"):
            cut = get("thresholds")
            if len(cut) != classes:
                raise ValueError(f"{len(cut)} thresholds for {classes} classes")
            score = F.transform(share, lambda p, i: F.when(F.get(F.lit(cut), i) == 0, F.when(p == 0, 0.0).otherwise(float("inf"))).otherwise(p / F.get(F.lit(cut), i)))
        best = (F.array_position(score, F.array_max(score)) - 1).cast("double")
        out = voted
        for name, value in ((get("predictionCol"), best), (get("rawPredictionCol"), array_to_vector(F.col("_votes"))), (get("probabilityCol"), array_to_vector(share))):
            if name:
                out = out.withColumn(name, value)
        return out.drop("_votes")


class RegressionModel(ForestModel):
    def predict(self, row: Sequence[float]) -> float:
        x = self._matrix([list(row)])
        return float(sum(t.flat().predict(x)[0] for t in self.trees) / len(self.trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        flats = [t.flat() for t in self.trees]

        @F.pandas_udf("double")
        def mean(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            x = np.stack(features.to_numpy())
            return pd.Series(sum(f.predict(x) for f in flats) / len(flats))

        return df.withColumn(self.getOrDefault("predictionCol"), mean(frames.features_array(df, self.getOrDefault("featuresCol"))))


def _train_points(df: DataFrame, strategy: Strategy, with_statistics: bool):
    strategy.validate()
    frame = frames.training_frame(df, "label", "features", "weight" if "weight" in df.columns else None, "row_id" if "row_id" in df.columns else None)
    result = train(frame, strategy, frames.num_features(frame))
    kind = ClassificationModel if strategy.classify else RegressionModel
    model = kind(result.trees, result.meta.num_features, strategy.num_classes)
    model.seconds = result.seconds
    if not with_statistics:
        return model
    return model, df.sparkSession.createDataFrame(result.nodes, "tree int, node int, rows double, impurity double, seconds double")


def train_classifier(df: DataFrame, strategy: Strategy | None = None, *, with_statistics: bool = False, **settings: Any):
    """A forest from a frame of label, features (and weight, row_id), by a strategy or its fields; depth 10 by default."""
    strategy = strategy or Strategy(**{"classify": True, "impurity": "gini"} | settings)
    if not strategy.classify or strategy.impurity not in CLASSIFY:
        raise ValueError("a classifier needs a classification strategy")
    return _train_points(df, strategy, with_statistics)


def train_regressor(df: DataFrame, strategy: Strategy | None = None, *, with_statistics: bool = False, **settings: Any):
    strategy = strategy or Strategy(**{"classify": False, "impurity": "variance", "num_classes": 0} | settings)
    if strategy.classify or strategy.impurity not in REGRESS:
        raise ValueError("a regressor needs a regression strategy")
    return _train_points(df, strategy, with_statistics)
