"""What shows at size only, on small tables made for it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from coppice import estimators as E
from coppice import queries
from coppice.plans import grow


@pytest.mark.parametrize("name", ["stump_weighted", "stump_variance"])
def test_gains_that_round_to_the_same_tie(spark, tmp_path, name):
    """The second feature gains more by less than a digit of the result: the first one is the answer of ORDER BY gain DESC, feature."""
    big = 10**9
    lines = [(1.0, 0.0, 0.0, "A", big, 0.0), (2.0, 0.01, 0.0, "N", big, 1.0), (2.0, 0.0, 0.0, "A", 1, 0.001)]
    own = spark.createDataFrame(lines, "l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linenumber int, l_extendedprice double")
    own = own.withColumn("l_orderkey", F.monotonically_increasing_id()).coalesce(1)
    if name == "stump_variance":
        own = own.withColumn("l_extendedprice", F.when(F.col("l_returnflag") == "N", 0.2).otherwise(F.when(F.col("l_quantity") == 2, 0.1).otherwise(0.0)))
    own.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name]).fetchall()
    got = queries.QUERIES[name](spark, str(tmp_path)).select("feature", "threshold", "left_weight", "gain").collect()
    assert [tuple(r) for r in got] == want and want[0][0] == 0


DATA = Path("/root/testdata/sf0.01")


@pytest.fixture
def held(monkeypatch):
    """The numbers of rows that trainings keep for their levels and local tasks."""
    seen, init = [], grow._State.__init__

    def counted(self, rows, strategy):
        init(self, rows, strategy)
        seen.append(self.rows.count())

    monkeypatch.setattr(grow._State, "__init__", counted)
    return seen


def answer(frame):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in frame), key=repr)


def check_against_sql(spark, name, held, most):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    assert answer(got.collect()) == answer(con.sql(queries.ORACLES[name]).select(*got.columns).fetchall())
    assert held and max(held) <= most


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_local_rows_are_merged_train_variance_local(spark, held):
    """60,000 rows have 50 x 11 x 9 combinations of bins: no task gets more, whatever the table's size."""
    check_against_sql(spark, "train_variance_local", held, 4_950)


def points(spark, n, weight=1.0):
    """Rows of which hardly two share their bins."""
    own = spark.range(n).select(*(F.xxhash64("id", F.lit(i)).alias(f"x{i}") for i in range(6)), "id")
    x = [F.abs(F.col(f"x{i}") % 1000).cast("double") for i in range(5)]
    return own.select(F.array(*x).alias("features"), ((x[0] > 500).cast("double") * 4 + (x[1] > 300).cast("double") * 2 + F.abs(F.col("x5") % 8) / 8).alias("label"), F.lit(weight).alias("weight"), F.col("id").alias("row_id"))


@pytest.mark.parametrize("weight", [1.0, 2.0**-10])
def test_local_tasks_keep_to_memory(spark, held, weight):
    """With 1 MB for the rows of a task, a limit of a billion doesn't send 20,000 distinct rows to one; nor do small weights."""
    df = points(spark, 20_000, weight).persist()
    settings = {"max_depth": 4, "max_bins": 32, "max_memory_mb": 1}
    tree, stats = E.train_regressor(df, **settings, local_max_rows=10**9, with_statistics=True)
    assert held == [20_000] and stats.count() > 0
    assert max(r["rows"] for r in stats.collect()) / weight < (1 << 20) / (4 * 8 * 7)
    a, b = (m.trees[0].copy() for m in (tree, E.train_regressor(df, **settings, local_max_rows=0)))
    assert (a.feature, a.threshold, a.left, a.right, a.prediction) == (b.feature, b.threshold, b.left, b.right, b.prediction)
    df.unpersist()


def test_deep_trees_are_whole_without_local_tasks(spark):
    """Nodes that are too large for memory go on below depth 30."""
    d = 32
    rows = [(float(i == d), [float(i == j or i == d) for j in range(d)], i) for i in range(d + 1)]
    rows = [(y, [1.0 - v if i < d else 1.0 for v in x], i) for y, x, i in rows]
    df = spark.createDataFrame(rows, "label double, features array<double>, row_id long").withColumn("weight", F.lit(1.0)).coalesce(1)
    assert E.train_classifier(df, num_classes=2, max_depth=d, max_memory_mb=0, local_max_rows=1000).trees[0].depth() == d


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_rows_are_merged_two_phase_equals_one_phase(spark, held):
    assert queries.two_phase_equals_one_phase(spark, str(DATA)).first()["same"]
    assert len(held) == 2 and max(held) <= 4_950


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_local_rows_are_merged_train_gini_local(spark, held):
    check_against_sql(spark, "train_gini_local", held, 3 * 4_950)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_local_rows_are_merged_train_weighted_local(spark, held):
    check_against_sql(spark, "train_weighted_local", held, 3 * 4_950)


def check_against_unmerged(spark, monkeypatch, name, held, most):
    got = answer(queries.QUERIES[name](spark, str(DATA)).collect())
    assert len(held) == 1 and held[0] <= most
    monkeypatch.setattr(grow, "MERGE_SUMS", 0)
    assert got == answer(queries.QUERIES[name](spark, str(DATA)).collect())
    assert held[1] == 60_000


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_rows_are_merged_train_forest(spark, monkeypatch, held):
    check_against_unmerged(spark, monkeypatch, "train_forest", held, 3 * 32 * 11 * 9)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_rows_are_merged_train_tree_deep(spark, monkeypatch, held):
    """Splits and children of all nodes are equal; sums of prices differ in their last digits."""
    got = queries.train_tree_deep(spark, str(DATA)).orderBy("id").collect()
    assert len(held) == 1 and held[0] <= 4_950
    monkeypatch.setattr(grow, "MERGE_SUMS", 0)
    want = queries.train_tree_deep(spark, str(DATA)).orderBy("id").collect()
    assert [(r["id"], r["leftChild"], r["rightChild"], r["featureIndex"]) for r in got] == [(r["id"], r["leftChild"], r["rightChild"], r["featureIndex"]) for r in want]
    assert [r["prediction"] for r in got] == pytest.approx([r["prediction"] for r in want])
