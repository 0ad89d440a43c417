from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier as BuiltInClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor as BuiltInRegressor
from pyspark.sql import functions as F

from coppice import estimators as E
from coppice.plans.local import fit as fit_locally
from coppice.sources.frames import labeled_points
from coppice.streaming.scoring import score_stream


def frame(spark, rows, arity=None):
    df = spark.createDataFrame([(i, float(y), Vectors.dense(list(map(float, x)))) for i, (y, x) in enumerate(rows)], ["row_id", "label", "features"])
    if arity:
        attrs = {"nominal": [{"idx": f, "num_vals": k} for f, k in arity.items()]}
        df = df.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"attrs": attrs, "num_attrs": len(rows[0][1])}}))
    return df


def ordered(n):
    label = lambda i: 0.0 if i < n / 10 else 1.0 if i < n / 2 else 0.0 if i < 0.9 * n else 1.0
    return [(label(i), (i, n - i)) for i in range(n)]


def categorical_binary(n=200):
    return [(1, (0, 1)) if i < 0.6 * n else (0, (1, 0)) for i in range(n)]


def categorical_multi(n=100):
    return [(2, (2, 2))] * n + [(1, (1, 2))] * n + [(2, (2, 2))] * n


def continuous_multi(n=100):
    return [(2, (2, i)) if i < 2 * n else (1, (2, i)) for i in range(3 * n)]


def compare(model, built_in, df):
    """Node counts, depths and predictions of a built-in tree."""
    assert (model.num_nodes, model.depth) == (built_in.numNodes, built_in.depth)
    own = [r["prediction"] for r in model.transform(df).orderBy("row_id").collect()]
    other = [r["prediction"] for r in built_in.transform(df).orderBy("row_id").collect()]
    assert np.allclose(own, other)


@pytest.mark.parametrize("local", [0, 10**9])
@pytest.mark.parametrize("cached", [True, False])
@pytest.mark.parametrize(("rows", "arity"), [(ordered(300), None), (categorical_binary(), {0: 3, 1: 2}), (categorical_multi(), {0: 3, 1: 3}), (continuous_multi(), {0: 3})], ids=["ordered", "binary", "multi", "mixed"])
def test_classifier_equals_built_in(spark, rows, arity, cached, local):
    if cached and local:
        pytest.skip("one of both")
    df = frame(spark, rows, arity).cache()
    settings = {"maxDepth": 4, "maxBins": 100, "impurity": "gini"}
    model = E.DecisionTreeClassifier(**settings, cacheNodeIds=cached, localMaxRows=local).fit(df)
    compare(model, BuiltInClassifier(**settings).fit(df), df)


def test_regressor_equals_built_in(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 2))
    df = frame(spark, [(6.3 + 4.7 * a + 7.2 * b, (a, b)) for a, b in x]).cache()
    for local in (0, 120):
        compare(E.DecisionTreeRegressor(maxDepth=4, maxBins=32, localMaxRows=local).fit(df), BuiltInRegressor(maxDepth=4, maxBins=32).fit(df), df)


def test_entropy_min_instances_min_gain(spark):
    df = frame(spark, ordered(200)).cache()
    settings = {"maxDepth": 3, "impurity": "entropy", "minInstancesPerNode": 15, "minInfoGain": 0.05}
    compare(E.DecisionTreeClassifier(**settings, localMaxRows=0).fit(df), BuiltInClassifier(**settings).fit(df), df)


def test_weights_are_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 2)), tuple(rng.integers(0, 6, 2).tolist())) for _ in range(80)]
    w = rng.integers(1, 4, len(rows)).tolist()
    weighted = labeled_points(spark, rows, w)
    copied = labeled_points(spark, [r for r, k in zip(rows, w) for _ in range(k)])
    settings = {"max_depth": 4, "num_classes": 2, "local_max_rows": 0, "custom_splits": [[0.5, 1.5, 2.5, 3.5, 4.5]] * 2}
    assert E.train_classifier(weighted, **settings).same(E.train_classifier(copied, **settings))


def test_two_phases_equal_one(spark):
    rng = np.random.default_rng(9)
    rows = [(float(rng.integers(0, 3)), rng.normal(size=4).tolist()) for _ in range(400)]
    df = labeled_points(spark, rows).cache()
    settings = {"num_classes": 3, "max_depth": 6, "num_trees": 1, "features": "all", "impurity": "gini"}
    one = E.train_classifier(df, **settings, local_max_rows=0)
    two, stats = E.train_classifier(df, **settings, local_max_rows=150, with_statistics=True)
    assert one.same(two)
    assert stats.count() > 0 and {r["rows"] < 150 for r in stats.collect()} == {True}


def test_deep_tree_through_the_estimator(spark):
    d = 40
    rows = [(0.0, [0.0 if j == i else 1.0 for j in range(d)]) for i in range(d)] + [(1.0, [1.0] * d)]
    model = E.DecisionTreeClassifier(maxDepth=d, localMaxRows=1000).fit(frame(spark, rows))
    assert model.depth == d


def test_constant_features(spark):
    model = E.DecisionTreeClassifier().fit(frame(spark, [(float(i % 2), (1, 2, 3)) for i in range(5)]))
    assert (model.depth, model.trees[0].impurity[0]) == (0, -1.0)


def test_xor_stops_where_nothing_is_gained(spark):
    df = frame(spark, [(0, (0, 0)), (1, (0, 1)), (1, (1, 0)), (0, (1, 1))])
    assert E.DecisionTreeClassifier(localMaxRows=0).fit(df).num_nodes == 1
    assert E.DecisionTreeClassifier(localMaxRows=0, zeroGain=True).fit(df).num_nodes == 7


def test_zero_gain_may_be_for_local_nodes_only(spark):
    """The first feature gains a little; below it lies XOR, where nothing gains: refused above, accepted locally."""
    xor = [(float(a ^ b), (side, a, b)) for side in (0, 1) for a in (0, 1) for b in (0, 1)]
    df = frame(spark, [*xor, (1.0, (1, 0, 1)), (1.0, (1, 1, 0))])
    sizes = {}
    for rows in (0, 100):
        for locally in (False, True):
            model = E.DecisionTreeClassifier(localMaxRows=rows, zeroGainLocally=locally).fit(df)
            sizes[rows, locally] = model.num_nodes
            tree = model.trees[0]
            assert tree.feature[0] >= 0
            if rows and locally:
                assert all(tree.flat().predict(np.array([x]))[0] == y for y, x in xor)
    assert sizes[0, False] == sizes[0, True] == sizes[100, False] < sizes[100, True]


def test_what_saving_would_lose_is_refused(spark, tmp_path):
    est = E.DecisionTreeClassifier()
    est.setCustomSplits([[0.5]])
    with pytest.raises(ValueError, match="customSplits"):
        est.save(str(tmp_path / "e"))


def test_forest_votes_and_columns(spark):
    df = frame(spark, ordered(200)).cache()
    model = E.RandomForestClassifier(numTrees=5, maxDepth=3, seed=4).fit(df)
    rows = model.transform(df).collect()
    for r in rows[:50]:
        assert sum(r["rawPrediction"]) == 5.0
        assert np.allclose(np.array(r["rawPrediction"]) / 5, r["probability"])
        assert r["prediction"] == np.argmax(r["rawPrediction"]) == model.predict(r["features"])
    assert model.tree_weights == [1.0] * 5
    again = E.RandomForestClassifier(numTrees=5, maxDepth=3, seed=4).fit(df.repartition(3))
    assert model.same(again)


def test_forest_mean(spark):
    df = frame(spark, [(i, (i,)) for i in range(64)]).cache()
    model = E.RandomForestRegressor(numTrees=3, maxDepth=3).fit(df)
    r = model.transform(df).first()
    assert np.isclose(r["prediction"], np.mean([t.flat().predict(np.array([r["features"]]))[0] for t in model.trees]))


def test_thresholds(spark):
    df = frame(spark, ordered(100))
    model = E.DecisionTreeClassifier(maxDepth=2).fit(df)
    model.setThresholds([1.0, 0.0])
    share = model.transform(df).select("probability", "prediction").collect()
    assert all(r["prediction"] == (1.0 if r["probability"][1] > 0 else 0.0) for r in share)


def test_save_and_load(spark, tmp_path):
    df = frame(spark, categorical_multi(), {0: 3, 1: 3})
    for i, model in enumerate((E.RandomForestClassifier(numTrees=3, maxDepth=3, predictionCol="p").fit(df), E.DecisionTreeRegressor(maxDepth=0).fit(df))):
        path = str(tmp_path / str(i))
        model.save(path)
        again = E.ForestModel.load(path)
        assert again.same(model) and type(again) is type(model) and again.getPredictionCol() == model.getPredictionCol()
        with pytest.raises(Exception):
            model.save(path)
        model.save(path, overwrite=True)


def test_estimator_params(spark, tmp_path):
    est = E.RandomForestClassifier(numTrees=7).setMaxDepth(3).setWeightCol("w")
    est.write().overwrite().save(str(tmp_path / "e"))
    again = E.RandomForestClassifier.load(str(tmp_path / "e"))
    assert (again.getNumTrees(), again.getMaxDepth(), again.getWeightCol()) == (7, 3, "w")
    est.customSplits = [[1.0]]
    assert est.copy().customSplits == [[1.0]]
    with pytest.raises(ValueError):
        E.DecisionTreeClassifier(numTrees=3)


def test_bad_input(spark):
    df = frame(spark, ordered(50))
    with pytest.raises(Exception, match="labels must be"):
        E.train_classifier(df, num_classes=2, max_depth=1).transform(df) if False else E.DecisionTreeClassifier().fit(df.withColumn("label", F.col("label") + 0.5))
    with pytest.raises(Exception, match="weight column"):
        E.DecisionTreeClassifier(weightCol="absent").fit(df)
    with pytest.raises(ValueError, match="impurity"):
        E.DecisionTreeClassifier(impurity="variance").fit(df)
    with pytest.raises(ValueError, match="classification"):
        E.train_classifier(df, E.Strategy(classify=False, impurity="variance"))
    with pytest.raises(ValueError, match="weights"):
        labeled_points(spark, [(1.0, [1.0])], [1.0, 2.0])
    with pytest.raises(ValueError, match="maxBins"):
        E.train_classifier(df, max_bins=1)


def test_extension_points(spark):
    seen = []

    def trainer(*args):
        return fit_locally(*args)

    def slow(rows, impurity):
        seen.append(rows)
        return impurity

    df = frame(spark, ordered(200))
    est = E.DecisionTreeClassifier(maxDepth=4, localMaxRows=150).setLocalTrainingAlgorithm(trainer).setTimePredictionStrategy(slow).setCustomSplits([[20.0, 100.0, 180.0], [100.0]])
    model = est.fit(df)
    assert seen and {t for t, f in zip(model.trees[0].threshold, model.trees[0].feature) if f == 0} <= {20.0, 100.0, 180.0}


def test_checkpointed_node_ids(spark):
    df = frame(spark, ordered(300)).cache()
    a = E.DecisionTreeClassifier(maxDepth=4, localMaxRows=0, checkpointInterval=1).fit(df)
    b = E.DecisionTreeClassifier(maxDepth=4, localMaxRows=0, cacheNodeIds=False, maxMemoryInMB=0).fit(df)
    assert a.same(b)


def test_plan_is_one_projection(spark):
    df = frame(spark, ordered(100))
    plan = E.DecisionTreeClassifier(maxDepth=2).fit(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_stream(spark, tmp_path):
    df = labeled_points(spark, ordered(100))
    model = E.train_classifier(df, num_classes=2, max_depth=3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").select("prediction").collect()
    assert got == model.transform(df).orderBy("row_id").select("prediction").collect()
    with pytest.raises(ValueError):
        score_stream(model, df, "", "")
